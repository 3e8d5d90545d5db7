"""A seeded corpus of any size, made on the executors from row numbers."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Words from which names are put together.
OPERATIONS = "create update delete find list validate export import merge cancel approve archive".split()
ENTITIES = "order invoice customer shipment payment product account ticket session report".split()
DETAILS = "total status history address limit discount schedule summary".split()


def source_file(number: int, seed: int = 7) -> tuple[str, str]:
    """(path, content) of file ``number``: 4 to 12 functions of different names, some of which call another of the file."""
    rng = random.Random(seed * 1_000_003 + number)
    domain, language = number % 15, ("py", "go", "js")[number % 3]
    names = rng.sample([(o, e, d) for o in OPERATIONS for e in ENTITIES for d in DETAILS], rng.randint(4, 12))
    camel = lambda n: n[0] + n[1].title() + n[2].title()
    out = []
    for k, n in enumerate(names):
        other = names[rng.randrange(k)] if k and rng.random() < 0.4 else None
        if language == "py":
            call = f"    {'_'.join(other)}(value)\n" if other else ""
            out.append(f"def {'_'.join(n)}(value):\n    # {n[0]} the {n[2]} of the {n[1]}\n{call}    return value + {rng.randrange(100)}\n")
        elif language == "go":
            call = f"\t{camel(other)}(value)\n" if other else ""
            out.append(f"// {camel(n)} handles the {n[2]} of the {n[1]}\nfunc {camel(n)}(value int) int {{\n{call}\treturn value + {rng.randrange(100)}\n}}\n")
        else:
            call = f"  {camel(other)}(value);\n" if other else ""
            out.append(f"// {n[0]} the {n[2]} of the {n[1]}\nexport function {camel(n)}(value) {{\n{call}  return value + {rng.randrange(100)};\n}}\n")
    head = {"py": "", "go": f"package domain{domain}\n\n", "js": ""}[language]
    return f"domain{domain}/module_{number}.{language}", head + "\n".join(out)


def corpus(spark: SparkSession, files: int, seed: int = 7) -> DataFrame:
    """(path, content) of a synthetic repository; the same seed gives the same files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([source_file(int(i), seed) for i in b["id"]], columns=["path", "content"])

    return spark.range(files).mapInPandas(run, "path string, content string")
