"""Grammars of the languages, for recognition only: operators have one level of
precedence, and forms that differ only in meaning share a rule."""

PYTHON = """
file : stmt* ;
stmt : small (';' small)* ';'? NEWLINE | compound ;
small : exprs | exprs ':' expr ('=' assigned)? | exprs augop assigned | target_eq+ assigned | yield_expr
  | 'del' exprs | 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' (expr ('from' expr)?)?
  | 'global' name% | 'nonlocal' name% | 'assert' expr (',' expr)? | 'import' dotted_as%
  | 'from' ('.' | '...')* dotted 'import' imported | 'from' ('.' | '...')+ 'import' imported
  | 'type' name typarams? '=' expr ;
target_eq : targets '=' ;
targets : target (',' target)* ','? ;
target : primary | '*' primary ;
assigned : exprs | yield_expr ;
augop : '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' ;
dotted : name | dotted '.' name ;
dotted_as : dotted ('as' name)? ;
imported : '*' | import_as% | '(' import_as%% ')' ;
import_as : name ('as' name)? ;
name : ID | 'match' | 'case' | 'type' ;
compound : if_stmt | 'while' named ':' block else_part? | async? 'for' targets 'in' exprs ':' block else_part?
  | 'try' ':' block (except+ else_part? finally? | finally) | async? 'with' with_items ':' block
  | decorator* definition | 'match' exprs ':' NEWLINE INDENT case+ DEDENT ;
async : 'async' ;
if_stmt : 'if' named ':' block elif* else_part? ;
elif : 'elif' named ':' block ;
else_part : 'else' ':' block ;
except : 'except' '*'? (expr (',' expr)* ('as' name)?)? ':' block ;
finally : 'finally' ':' block ;
with_items : with_item% | '(' with_item%% ')' ;
with_item : expr ('as' target)? ;
decorator : '@' named NEWLINE ;
definition : async? 'def' name typarams? '(' params? ')' ('->' expr)? ':' block | 'class' name typarams? ('(' args? ')')? ':' block ;
typarams : '[' typaram%% ']' ;
typaram : '*' name | '**' name | name (':' expr)? ('=' expr)? ;
params : param%% ;
param : name (':' expr)? ('=' expr)? | '*' (name (':' star_expr)?)? | '**' name (':' expr)? | '/' ;
block : NEWLINE INDENT stmt+ DEDENT | small (';' small)* ';'? NEWLINE ;
case : 'case' patterns ('if' named)? ':' block ;
patterns : pattern (',' pattern)* ','? ;
pattern : or_pattern ('as' name)? | '*' name ;
or_pattern : closed | or_pattern '|' closed ;
closed : '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | dotted | '(' patterns? ')' | '[' patterns? ']'
  | '{' map_pattern%% '}' | '{' '}' | dotted '(' arg_pattern%% ')' | dotted '(' ')' ;
map_pattern : or_pattern ':' pattern | '**' name ;
arg_pattern : pattern | name '=' pattern ;
exprs : star_expr (',' star_expr)* ','? ;
star_expr : named | '*' expr ;
named : expr | name ':=' expr ;
yield_expr : 'yield' exprs? | 'yield' 'from' expr ;
expr : disjunct | disjunct 'if' disjunct 'else' expr | 'lambda' lambda_params? ':' expr ;
lambda_params : lambda_param%% ;
lambda_param : name ('=' expr)? | '*' name? | '**' name | '/' ;
disjunct : unary | disjunct binop unary ;
binop : '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '<<' | '>>' | '&' | '|' | '^' | '<' | '>' | '<=' | '>=' | '==' | '!='
  | 'in' | 'not' 'in' | 'is' | 'is' 'not' | 'and' | 'or' ;
unary : primary | '-' unary | '+' unary | '~' unary | 'not' unary | 'await' unary ;
primary : atom | primary '.' name | primary '(' args? ')' | primary '[' subscript%% ']' ;
args : arg%% ;
arg : named comp? | name '=' expr | '*' expr | '**' expr ;
subscript : named | '*' expr | expr? ':' expr? (':' expr?)? ;
atom : name | NUM | STR+ | 'None' | 'True' | 'False' | '...' | '(' ')' | '(' exprs ')' | '(' yield_expr ')' | '(' named comp ')'
  | '[' ']' | '[' exprs ']' | '[' named comp ']' | '{' '}' | '{' exprs '}' | '{' named comp '}' | '{' pair%% '}' | '{' expr ':' expr comp '}' ;
pair : expr ':' expr | '**' expr ;
comp : comp_for+ ;
comp_for : async? 'for' targets 'in' disjunct comp_if* ;
comp_if : 'if' (disjunct | name ':=' disjunct | 'lambda' lambda_params? ':' expr) ;
"""

_JS_STATEMENTS = """
file : item* ;
item : stmt | import | export ;
import : 'import' STR with_part? ';' | 'import' import_what 'from' STR with_part? ';' ;
with_part : 'with' object ;
import_what : name | name ',' named_imports | name ',' '*' 'as' name | named_imports | '*' 'as' name ;
named_imports : '{' import_spec%% '}' | '{' '}' ;
export : 'export' 'default' (expr_nofn ';' | fn_decl | class_decl) | 'export' decl
  | 'export' named_imports ('from' STR with_part?)? ';' | 'export' '*' ('as' pname)? 'from' STR with_part? ';' ;
stmt : block | var_stmt | ';' | expr_stmt ';' | if_stmt | 'for' '(' for_head ')' stmt | 'for' 'await' '(' for_head ')' stmt
  | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'do' stmt 'while' '(' expr ')'
  | 'continue' name? ';' | 'break' name? ';' | 'return' expr? ';' | 'throw' expr ';' | 'with' '(' expr ')' stmt
  | 'switch' '(' expr ')' '{' switch_case* '}' | name ':' stmt
  | 'try' block ('catch' ('(' binding ')')? block)? ('finally' block)? | 'debugger' ';' | fn_decl | class_decl ;
if_stmt : 'if' '(' expr ')' stmt | 'if' '(' expr ')' stmt 'else' stmt ;
block : '{' stmt* '}' ;
decl : var_stmt | fn_decl | class_decl ;
var_stmt : var_kind var% ';' ;
var_kind : 'var' | 'let' | 'const' | 'using' ;
for_head : (var_kind var% | expr)? ';' expr? ';' expr? | var_kind pattern ('of' | 'in') expr | postfix ('of' | 'in') expr ;
switch_case : 'case' expr ':' stmt* | 'default' ':' stmt* ;
object_pattern : '{' pattern_prop%% '}' | '{' '}' ;
array_pattern : '[' (pattern_item? ',')* pattern_item? ']' ;
pattern_prop : key ':' pattern ('=' assign)? | name ('=' assign)? | '...' pattern ;
pattern_item : pattern ('=' assign)? | '...' pattern ;
pattern : name | object_pattern | array_pattern ;
expr : assign | expr ',' assign ;
expr_stmt : estart | expr_stmt ',' assign ;
augop : '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '**=' | '&&=' | '||=' | '??=' | '<<=' | '>' '>=' | '>' '>' '>=' ;
assign : cond | unary_lhs '=' assign | unary_lhs augop assign | arrow | 'yield' | 'yield' assign | 'yield' '*' assign ;
unary_lhs : postfix ;
cond : binary | binary '?' assign ':' assign ;
binop : '+' | '-' | '*' | '/' | '%' | '**' | '&' | '|' | '^' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '&&' | '||' | '??'
  | '<<' | '>' '>' | '>' '>' '>' | 'in' | 'instanceof' ;
unary : update | unop unary ;
unop : '!' | '~' | '+' | '-' | 'typeof' | 'void' | 'delete' | 'await' | '++' | '--' ;
update : postfix | postfix '++' | postfix '--' ;
args : '(' arg%% ')' | '(' ')' ;
arg : assign | '...' assign ;
array : '[' ((arg)? ',')* (arg)? ']' ;
object : '{' prop%% '}' | '{' '}' ;
key : pname | STR | NUM | '[' assign ']' ;
template : TPL | TPL_S expr (TPL_M expr)* TPL_E ;
literal : NUM | STR | REGEX | 'null' | 'true' | 'false' ;
binary : unary | binary binop unary ;
"""

# the statement forms of expressions leave out those that begin with '{', function and class
_JS_EXPR = """
postfix : atom | postfix '.' pname | postfix '?.' pname | postfix '[' expr ']' | postfix '?.' '[' expr ']' | postfix args | postfix '?.' args | postfix template ;
atom : name | 'this' | 'super' | literal | template | array | object | '(' expr ')' | fn_expr | class_expr | 'new' postfix | 'new' '.' 'target'
  | 'import' '.' pname | 'import' args jsx_atom ;
"""

_JS_NAMES = """
name : ID | 'of' | 'as' | 'from' | 'async' | 'get' | 'set' | 'static' | 'let' | 'target' | 'using' ;
pname : name | 'this' | 'super' | 'null' | 'true' | 'false' | 'if' | 'else' | 'for' | 'while' | 'do' | 'return' | 'break' | 'continue' | 'throw' | 'try' | 'catch'
  | 'finally' | 'switch' | 'case' | 'default' | 'var' | 'const' | 'function' | 'class' | 'extends' | 'new' | 'delete' | 'typeof' | 'void' | 'in' | 'instanceof'
  | 'import' | 'export' | 'yield' | 'await' | 'with' | 'debugger' ;
"""


def _script(typed: bool, jsx: bool) -> str:
    t = lambda a, b="": a if typed else b
    words = " | 'type' | 'interface' | 'namespace' | 'module' | 'declare' | 'abstract' | 'readonly' | 'keyof' | 'infer' | 'is' | 'asserts' | 'satisfies' | 'global' | 'override' | 'public' | 'private' | 'protected' | 'unique' | 'accessor'"
    text = _JS_STATEMENTS + _JS_NAMES.replace("'using' ;", "'using'" + t(words) + " ;").replace("'debugger' ;", "'debugger'" + t(" | 'enum' | 'implements'") + " ;")
    atoms = "name | 'this' | 'super' | literal | template | array | '(' expr ')' | 'new' new_target | 'new' new_target args | 'new' '.' 'target' | 'import' '.' pname | 'import' args" + (" | JSX_B jsx_part* JSX_E" if jsx else "")
    tails = "'.' pname | {0} '?.' pname | {0} '[' expr ']' | {0} '?.' '[' expr ']' | {0} args | {0} '?.' args | {0} template" + t(" | {0} '!' | {0} targs args | {0} '?.' targs args | {0} targs")
    text += f"""
new_target : new_atom | new_target '.' pname | new_target '[' expr ']'{t(" | new_target targs")} ;
new_atom : name | 'this' | literal | template | array | object | '(' expr ')' | fn_expr | class_expr | 'new' new_target args | 'new' '.' 'target' | 'import' '.' pname ;
postfix : atom | postfix {tails.format('postfix')} ;
atom : {atoms} | object | fn_expr | class_expr ;
sfix : satom | sfix {tails.format('sfix')} ;
satom : {atoms} ;
estart : scond | sfix '=' assign | sfix augop assign | object_pattern '=' assign | arrow | 'yield' | 'yield' assign | 'yield' '*' assign ;
scond : sbinary | sbinary '?' assign ':' assign ;
sbinary : sunary | sbinary binop unary{t(" | sbinary 'as' type | sbinary 'as' 'const' | sbinary 'satisfies' type")} ;
sunary : sfix | sfix '++' | sfix '--' | unop unary{t(" | '<' type '>' unary") if not jsx else ""} ;
expr_nofn : estart | object | object dtail+ | expr_nofn ',' assign ;
dtail : '.' pname | '[' expr ']' | args{t(" | 'as' type | 'as' 'const' | 'satisfies' type")} ;
arrow : arrow_head '=>' arrow_body | 'async' arrow_head '=>' arrow_body ;
arrow_body : block | bstart ;
bstart : scond | sfix '=' assign | sfix augop assign | arrow ;
arrow_head : name | {t("tparams? ")}'(' params? ')'{t(" (':' rtype)?")} ;
params : param%% ;
param : {t("decorator* modifier* ")}pattern{t(" '?'? (':' type)?")} ('=' assign)? | '...' pattern{t(" (':' type)?")}{t(" | 'this' ':' type")} ;
binding : pattern{t(" (':' type)?")} ;
var : pattern{t(" '!'? (':' type)?")} ('=' assign)? ;
fn_decl : fn_word '*'? name {t("tparams? ")}'(' params? ')' {t("(':' rtype)? ")}fn_body | 'function' '*'? '(' params? ')' fn_body ;
fn_word : 'function' | 'async' 'function' ;
fn_body : block{t(" | ';'")} ;
fn_expr : fn_word '*'? name? {t("tparams? ")}'(' params? ')' {t("(':' rtype)? ")}block ;
class_decl : class_word name? class_rest | decorator+ class_word name? class_rest ;
class_word : 'class'{t(" | 'abstract' 'class'")} ;
class_expr : 'class' name? class_rest | decorator+ 'class' name? class_rest ;
class_rest : {t("tparams? ")}('extends' postfix)? {t("('implements' type%)? ")}'{{' member* '}}' ;
decorator : '@' postfix ;
member : ';' | decorator* modifier* member_body ;
modifier : 'static'{t(" | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' | 'accessor'")} ;
member_body : 'async'? '*'? key {t("'?'? tparams? ")}'(' params? ')' {t("(':' rtype)? ")}fn_body
  | ('get' | 'set') key '(' params? ')' {t("(':' rtype)? ")}fn_body
  | key {t("('?' | '!')? (':' type)? ")}('=' assign)? ';' | 'static' block{t(" | index_sig ';'")} ;
prop : key ':' assign | name ('=' assign)? | '...' assign | 'async'? '*'? key {t("tparams? ")}'(' params? ')' {t("(':' rtype)? ")}block | ('get' | 'set') key '(' params? ')' {t("(':' rtype)? ")}block ;
import_spec : {t("'type'? ")}pname ('as' pname)? | STR 'as' pname ;
"""
    if jsx:
        text += "jsx_part : JSX_L JSX_R | JSX_L expr JSX_R | JSX_L '...' assign JSX_R ;\n"
    if typed:
        text = text.replace("decl : var_stmt |", "decl : tdecl | 'declare' decl | var_stmt |").replace("| fn_decl | class_decl ;\nif_stmt", "| fn_decl | class_decl | tdecl | 'declare' decl ;\nif_stmt")
        text = text.replace("import : 'import' STR", "import : 'import' 'type' import_what 'from' STR ';' | 'import' name '=' (postfix) ';' | 'import' STR").replace("export : ", "export : 'export' '=' expr ';' | 'export' 'as' 'namespace' name ';' | 'export' 'type' named_imports ('from' STR)? ';' | 'export' 'default' tdecl | ")
        text = text.replace("binary : unary |", "binary : unary | binary 'as' type | binary 'as' 'const' | binary 'satisfies' type |")
        if not jsx:
            text = text.replace("unary : update |", "unary : update | '<' type '>' unary |")
        text += """
tdecl : 'interface' name tparams? ('extends' type%)? '{' type_member* '}' | 'type' name tparams? '=' type ';' | 'const'? 'enum' name '{' (enum_item%%)? '}'
  | ('namespace' | 'module') (qname | STR) '{' item* '}' | 'module' STR ';' | 'global' '{' item* '}' ;
enum_item : key ('=' assign)? ;
qname : name | qname '.' pname ;
tparams : '<' tparam%% '>' ;
tparam : ('const' | 'in' | 'out')? name ('extends' type)? ('=' type)? ;
targs : '<' type%% '>' ;
rtype : type | 'asserts'? (name | 'this') 'is' type | 'asserts' (name | 'this') ;
type : union | union 'extends' union '?' type ':' type | tparams? '(' params? ')' '=>' rtype | 'abstract'? 'new' tparams? '(' params? ')' '=>' type ;
union : '|'? inter | '&' inter | union '|' inter | union '&' inter ;
inter : postfix_type | ('keyof' | 'readonly' | 'unique') inter | 'infer' name ('extends' postfix_type)? ;
postfix_type : base_type | postfix_type '[' ']' | postfix_type '[' type ']' ;
base_type : tref targs? | 'void' | 'null' | 'this' | 'true' | 'false' | STR | '-'? NUM | template_type | '(' type ')' | '{' type_member* '}' | '[' (tuple_item%%)? ']'
  | 'typeof' tref targs? | 'typeof' 'import' '(' STR ')' | 'import' '(' type ')' ('.' qname)? targs? | '{' mapped '}' ;
template_type : TPL | TPL_S type (TPL_M type)* TPL_E ;
tref : name | tref '.' pname ;
tuple_item : '...'? (name '?'? ':')? '...'? type '?'? ;
mapped : (('+' | '-')? 'readonly')? '[' name 'in' type ('as' type)? ']' (('+' | '-')? '?')? (':' type)? ';'? ;
type_member : member_sig (';' | ',') | member_sig_last ;
member_sig_last : '@never' ;
member_sig : modifier* key '?'? (':' type)? | modifier* ('get' | 'set')? key '?'? tparams? '(' params? ')' (':' rtype)? | tparams? '(' params? ')' (':' rtype)? | 'new' tparams? '(' params? ')' (':' rtype)? | modifier* index_sig ;
index_sig : '[' name ':' type ']' ':' type ;
"""
        text = text.replace("type_member : member_sig (';' | ',') | member_sig_last ;\nmember_sig_last : '@never' ;", "type_member : member_sig (';' | ',') ;")
    return text


_JAVA = """
file : package? (import | ';')* top* ;
package : annotation* 'package' qname ';' ;
import : 'import' 'static'? qname ('.' '*')? ';' ;
top : modifier* type_decl | ';' | modifier* 'module' qname '{' directive* '}' | member_decl ;
directive : ID (ID | qname)* ';' ;
qname : name | qname '.' name ;
name : ID | 'record' | 'var' | 'yield' | 'sealed' | 'permits' | 'module' ;
modifier : annotation | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed' ;
annotation : '@' qname | '@' qname '(' (annotation_arg%%)? ')' ;
annotation_arg : (name '=')? annotation_value ;
annotation_value : cond | annotation | '{' (annotation_value%%)? '}' ;
type_decl : 'class' name tparams? ('extends' type)? ('implements' type%)? ('permits' type%)? body | 'interface' name tparams? ('extends' type%)? ('permits' type%)? body
  | '@' 'interface' name body | 'enum' name ('implements' type%)? '{' (enum_item%%)? (';' member*)? '}' | 'record' name tparams? '(' params? ')' ('implements' type%)? body ;
enum_item : annotation* name args? body? ;
body : '{' member* '}' ;
member : ';' | modifier* type_decl | 'static'? block | member_decl ;
member_decl : modifier* tparams? (type name | 'void' name | name) '(' params? ')' dims? ('throws' type%)? (block | ';' | 'default' annotation_value ';') | modifier* type var% ';' | modifier* name block ;
tparams : '<' tparam% '>' ;
tparam : annotation* name ('extends' type ('&' type)*)? ;
params : param% ;
param : modifier* type '...'? annotation* (name | 'this' | name '.' 'this') dims? ;
dims : '[' ']' | dims '[' ']' ;
type : base_type | base_type dims ;
base_type : prim | annotation+ prim | cref ;
prim : 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double' ;
cref : name targs? | cref '.' annotation* name targs? | annotation+ name targs? ;
targs : '<' (targ%)? '>' ;
targ : type | annotation* '?' (('extends' | 'super') type)? ;
var : name dims? ('=' var_init)? ;
var_init : expr | '{' (var_init%%)? '}' ;
block : '{' stmt* '}' ;
stmt : block | ';' | modifier* type var% ';' | modifier* type_decl | expr_stmt ';' | 'if' '(' expr ')' stmt | 'if' '(' expr ')' stmt 'else' stmt | 'while' '(' expr ')' stmt
  | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' for_head ')' stmt | 'return' expr? ';' | 'throw' expr ';' | 'break' name? ';' | 'continue' name? ';' | 'yield' expr ';'
  | switch | 'synchronized' '(' expr ')' block | name ':' stmt | 'assert' expr (':' expr)? ';'
  | 'try' block (catch+ finally? | finally) | 'try' '(' resource (';' resource)* ';'? ')' block catch* finally? ;
resource : modifier* type name '=' expr | postfix ;
catch : 'catch' '(' modifier* type ('|' type)* name ')' block ;
finally : 'finally' block ;
for_head : (modifier* type var% | expr_stmt%)? ';' expr? ';' (expr_stmt%)? | modifier* type name ':' expr ;
switch : 'switch' '(' expr ')' '{' switch_part* '}' ;
switch_part : case_label (':' | '->') stmt* ;
case_label : 'case' case_item% ('when' expr)? | 'default' ;
case_item : cond | 'default' | type name | cref '(' (case_item%)? ')' name? ;
expr_stmt : postfix '=' expr | postfix augop expr | '++' unary | '--' unary | postfix '++' | postfix '--' | call | new ;
augop : '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>=' ;
expr : cond | postfix '=' expr | postfix augop expr | lambda ;
lambda : name '->' lambda_body | '(' (name%)? ')' '->' lambda_body | '(' params ')' '->' lambda_body ;
lambda_body : expr | block ;
cond : binary | binary '?' expr ':' expr ;
binary : unary | binary binop unary | binary 'instanceof' modifier* type name? | binary 'instanceof' cref '(' (case_item%)? ')' ;
binop : '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&&' | '||' | '<<' | '>' '>' | '>' '>' '>' ;
unary : postfix | postfix '++' | postfix '--' | ('+' | '-' | '!' | '~' | '++' | '--') unary | '(' type ('&' type)* ')' unary | '(' type ('&' type)* ')' lambda ;
postfix : name | literal | 'this' | 'super' | '(' expr ')' | call | new | postfix '.' name | postfix '.' 'this' | postfix '.' 'super' | postfix '.' 'class' | type '.' 'class' | 'void' '.' 'class' | postfix '[' expr ']' | switch
  | postfix '::' targs? (name | 'new') | type '::' targs? (name | 'new') ;
call : name args | 'this' args | 'super' args | postfix '.' targs? (name | 'super') args ;
new : (postfix '.')? 'new' annotation* targs? cref args body? | 'new' base_type dim+ dims? | 'new' base_type dims '{' (var_init%%)? '}' ;
dim : '[' expr ']' ;
args : '(' (expr%)? ')' ;
literal : NUM | STR | CHR | 'true' | 'false' | 'null' ;
"""

_GO = """
file : 'package' ID ';' (import ';')* (top ';')* top? ;
import : 'import' import_spec | 'import' '(' (import_spec ';')* import_spec? ')' ;
import_spec : (ID | '.')? STR ;
top : decl | 'func' ID tparams? signature block? | 'func' params ID signature block? ;
decl : 'var' var_spec | 'var' '(' (var_spec ';')* var_spec? ')' | 'const' const_spec | 'const' '(' (const_spec ';')* const_spec? ')' | 'type' type_spec | 'type' '(' (type_spec ';')* type_spec? ')' ;
var_spec : ID% type ('=' expr%)? | ID% '=' expr% ;
const_spec : ID% (type? '=' expr%)? ;
type_spec : ID tparams? '='? type ;
tparams : '[' tparam%% ']' ;
tparam : ID% constraint ;
constraint : cterm | constraint '|' cterm ;
cterm : '~'? type ;
signature : params result? ;
result : type | params ;
params : '(' (param%%)? ')' ;
param : ID? '...'? type | ID '...' type ;
type : tname | tname '[' type%% ']' | '*' type | '(' type ')' | '[' ']' type | '[' expr ']' type | '[' '...' ']' type | 'map' '[' type ']' type | 'chan' type | 'chan' '<-' type | '<-' 'chan' type
  | 'func' signature | 'struct' '{' (field ';')* field? '}' | 'interface' '{' (method ';')* method? '}' ;
tname : ID | ID '.' ID ;
field : ID% type STR? | '*'? tname ('[' type%% ']')? STR? ;
method : ID signature | constraint ;
block : '{' stmts '}' ;
stmts : (stmt? ';')* stmt? ;
stmt : decl | simple | 'return' (expr%)? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | block | if | switch | select | for | 'go' expr | 'defer' expr | ID ':' stmt? ;
simple : expr | expr '<-' expr | expr '++' | expr '--' | expr% assign_op expr% | expr% '=' 'range' expr | expr% ':=' 'range' expr ;
assign_op : '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ;
if : 'if' (simple? ';')? simple block ('else' (if | block))? ;
for : 'for' block | 'for' simple block | 'for' simple? ';' simple? ';' simple? block | 'for' 'range' expr block ;
switch : 'switch' (simple? ';')? simple? '{' case* '}' ;
case : ('case' switch_item%% | 'default') ':' stmts ;
switch_item : expr | type ;
select : 'select' '{' comm* '}' ;
comm : ('case' simple | 'default') ':' stmts ;
expr : unary | expr binop unary ;
binop : '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&&' | '||' | '<<' | '>>' | '&^' ;
unary : primary | ('+' | '-' | '!' | '^' | '*' | '&' | '<-') unary ;
primary : ID | NUM | STR | CHR | '(' expr ')' | 'func' signature block | primary '.' ID | primary '.' '(' (type | 'type') ')' | primary '[' expr? (':' expr?)? (':' expr)? ']' | primary '[' type ',' type%% ']'
  | primary '(' (arg%% )? ')' | primary '(' arg% '...' ','? ')' | literal_type '{' (element%%)? '}' | conv_type '(' expr ','? ')' ;
literal_type : tname | tname '[' type%% ']' | '[' ']' type | '[' expr ']' type | '[' '...' ']' type | 'map' '[' type ']' type | 'struct' '{' (field ';')* field? '}' ;
conv_type : '[' ']' type | 'map' '[' type ']' type | 'chan' type | 'interface' '{' (method ';')* method? '}' | '(' '*' type ')' | '(' 'func' signature ')' | '[' expr ']' type ;
arg : expr | type_arg ;
type_arg : '[' ']' type | 'map' '[' type ']' type | 'chan' type | '*' type_arg | 'struct' '{' (field ';')* field? '}' | 'interface' '{' (method ';')* method? '}' | 'func' signature | '[' expr ']' type ;
element : value | value ':' value ;
value : expr | '{' (element%%)? '}' ;
"""

_RUST = """
file : ('#' '!' '[' tokens ']')* item* ;
item : attr* vis? item_body | attr* macro_item ;
attr : '#' '[' tokens ']' ;
vis : 'pub' | 'pub' '(' ('crate' | 'self' | 'super' | 'in' path) ')' | 'crate' ;
tokens : token* ;
token : '(' tokens ')' | '[' tokens ']' | '{' tokens '}' | anyword | anyop ;
anyword : ID | NUM | STR | CHR | LIFE | 'as' | 'break' | 'const' | 'continue' | 'crate' | 'else' | 'enum' | 'extern' | 'false' | 'fn' | 'for' | 'if' | 'impl' | 'in' | 'let' | 'loop' | 'match' | 'mod' | 'move' | 'mut' | 'pub' | 'ref' | 'return' | 'self' | 'Self' | 'static' | 'struct' | 'super' | 'trait' | 'true' | 'type' | 'unsafe' | 'use' | 'where' | 'while' | 'async' | 'await' | 'dyn' | 'union' | 'macro_rules' | 'default' | 'auto' ;
anyop : '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '!' | '~' | '<' | '>' | '=' | '?' | ':' | ';' | ',' | '.' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '==' | '!=' | '<=' | '>=' | '&&' | '||' | '<<' | '<<=' | '->' | '=>' | '::' | '..' | '...' | '..=' | '@' | '#' | '$' ;
name : ID | 'union' | 'macro_rules' | 'default' | 'auto' ;
macro_item : path '!' name? ('(' tokens ')' ';' | '[' tokens ']' ';' | '{' tokens '}') ;
item_body : 'use' use_tree ';' | 'extern' 'crate' (name | 'self') ('as' name)? ';' | 'mod' name (';' | '{' item* '}') | fn | 'struct' name generics? struct_rest | 'union' name generics? where? '{' (field%%)? '}'
  | 'enum' name generics? where? '{' (variant%%)? '}' | 'type' name generics? (':' bounds?)? where? ('=' type)? where? ';' | ('const' | 'static') 'mut'? name ':' type ('=' expr)? ';'
  | 'default'? 'unsafe'? 'impl' generics? 'const'? '!'? type ('for' type)? where? '{' item* '}' | 'unsafe'? 'auto'? 'trait' name generics? (':' bounds?)? where? '{' item* '}' | 'unsafe'? 'extern' STR? '{' item* '}' ;
use_tree : use_path | use_path 'as' name | use_path '::' '*' | '*' | '::' '*' | use_path '::' '{' (use_tree%%)? '}' | '::'? '{' (use_tree%%)? '}' ;
use_path : '::'? pathword | use_path '::' pathword ;
pathword : name | 'self' | 'super' | 'crate' | 'Self' ;
fn : qual* 'fn' name generics? '(' (fn_param%%)? ')' ('->' type)? where? (block | ';') ;
qual : 'const' | 'async' | 'unsafe' | 'extern' STR? | 'default' ;
fn_param : attr* self_param | attr* pattern ':' type | '...' ;
self_param : 'mut'? 'self' (':' type)? | '&' LIFE? 'mut'? 'self' ;
struct_rest : where? '{' (field%%)? '}' | '(' (tuple_field%%)? ')' where? ';' | where? ';' ;
field : attr* vis? name ':' type ;
tuple_field : attr* vis? type ;
variant : attr* name ('{' (field%%)? '}' | '(' (tuple_field%%)? ')')? ('=' expr)? ;
generics : '<' (gparam%%)? '>' ;
gparam : attr* LIFE (':' (LIFE ('+' LIFE)*)?)? | attr* name (':' bounds?)? ('=' type)? | 'const' name ':' type ('=' expr)? ;
where : 'where' (wpred%%)? ;
wpred : LIFE ':' (LIFE ('+' LIFE)*)? | ('for' generics)? type ':' bounds? ;
bounds : bound | bounds '+' bound ;
bound : LIFE | '?'? ('for' generics)? '~'? 'const'? path_type | '(' bound ')' ;
type : path_type | '&' LIFE? 'mut'? type | '&&' LIFE? 'mut'? type | '*' ('const' | 'mut') type | '(' (type%%)? ')' | '[' type ']' | '[' type ';' expr ']' | '!' | ('for' generics)? qual* 'fn' '(' (bare%%)? ')' ('->' type)? | ('impl' | 'dyn') bounds | path '!' '(' tokens ')' ;
bare : (name ':')? type | '...' ;
path_type : pseg | '::' pseg | path_type '::' pseg | '<' type ('as' type)? '>' '::' pseg ;
pseg : pathword | pathword gargs | pathword '::' gargs | pathword '(' (type%%)? ')' ('->' type)? ;
gargs : '<' (garg%%)? '>' ;
garg : LIFE | type | name gargs? '=' type | name gargs? ':' bounds | '-'? literal | block ;
path : eseg | '::' eseg | path '::' eseg | '<' type ('as' type)? '>' '::' eseg ;
eseg : pathword | gargs_turbo ;
gargs_turbo : '<' (garg%%)? '>' ;
pattern : '|'? pat1 | pattern '|' pat1 ;
pat1 : '_pat' | literal | '-' literal | 'ref'? 'mut'? name ('@' pat1)? | '&' 'mut'? pat1 | '&&' 'mut'? pat1 | path | path '(' (pattern%%)? ')' | path '{' (fpat%%)? '}' | '(' (pattern%%)? ')' | '[' (pattern%%)? ']' | range_pat | '..' | path '!' '(' tokens ')' | 'const' block ;
range_pat : rend ('..=' | '...' | '..') rend | rend '..' | '..=' rend ;
rend : '-'? literal | path ;
fpat : attr* (name | NUM) ':' pattern | attr* 'ref'? 'mut'? name | '..' ;
literal : NUM | STR | CHR | 'true' | 'false' ;
block : '{' stmt* expr? '}' | '{' stmt* attr+ expr '}' ;
stmt : ';' | item | attr* 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';' | attr* expr ';' | attr* block_expr ;
block_expr : block | 'unsafe' block | 'async' 'move'? block | 'const' block | if | (LIFE ':')? loop | match | macro_brace ;
macro_brace : path '!' '{' tokens '}' ;
if : 'if' cond block ('else' (if | block))? ;
cond : nexpr | nexpr '&&' let_cond | let_cond ;
let_cond : 'let' pattern '=' nexpr ('&&' let_cond)? ;
loop : 'loop' block | 'while' cond block | 'for' pattern 'in' nexpr block ;
match : 'match' nexpr '{' arm* '}' ;
arm : attr* pattern ('if' cond_any)? '=>' (expr ',' | block_expr ','? | expr_last) ;
cond_any : expr | 'let' pattern '=' expr ;
expr_last : '@never' ;
expr : eb ;
""" + "".join(
    f"""
{e}b : {e}range | {e}u assignop {e}b | ('move' | 'async' | 'static')* ('|' (cparam%%)? '|' | '||') ({e}b | '->' type block) | 'return' {e}b? | 'break' LIFE? {e}b? | 'continue' LIFE? ;
{e}range : {e}bin | {e}bin ('..' | '..=') {e}bin? | ('..' | '..=') {e}bin? ;
{e}bin : {e}u | {e}bin binop {e}u | {e}bin binop {e}closure | {e}bin 'as' type ;
{e}closure : 'move'? ('|' (cparam%%)? '|' | '||') {e}b | 'return' {e}b? | 'break' LIFE? | 'continue' LIFE? ;
{e}u : {e}p | ('-' | '!' | '*') {e}u | ('&' | '&&') 'mut'? {e}u | '&' 'raw'? ('const' | 'mut') {e}u ;
{e}p : {e}a | {e}p '.' name | {e}p '.' NUM | {e}p '.' 'await' | {e}p '.' name '::' gargs args | {e}p args | {e}p '[' expr ']' | {e}p '?' ;
{e}a : literal | path | path '!' '(' tokens ')' | path '!' '[' tokens ']' | macro_brace | '(' (expr%%)? ')' | '[' (expr%%)? ']' | '[' expr ';' expr ']' | block | 'unsafe' block | 'async' 'move'? block | 'const' block | if | (LIFE ':')? loop | match {s} ;
"""
    for e, s in (("e", "| path '{' (finit%% )? '}' | path '{' (finit ',')* '..' expr? '}'"), ("n", ""))
) + """
nexpr : nb ;
args : '(' (expr%%)? ')' ;
finit : attr* (name | NUM) (':' expr)? ;
cparam : attr* pat1 (':' type)? ;
assignop : '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' ;
binop : '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&&' | '||' | '<<' | '>' '>' ;
"""
_RUST = _RUST.replace("pat1 : '_pat' |", "pat1 :").replace(" | expr_last) ;", ") ;").replace("expr_last : '@never' ;\n", "").replace("arm* '}' ;", "arm* last_arm? '}' ;").replace("cond_any : expr |", "last_arm : attr* pattern ('if' cond_any)? '=>' expr ;\ncond_any : expr |")

_PHP = """
file : top* ;
top : HTML | stmt ;
stmt : ';' | block | simple ';' | 'if' '(' expr ')' stmt ('elseif' '(' expr ')' stmt)* else? | 'if' '(' expr ')' ':' top* ('elseif' '(' expr ')' ':' top*)* ('else' ':' top*)? 'endif' ';'
  | 'while' '(' expr ')' (stmt | ':' top* 'endwhile' ';') | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' (expr%)? ';' (expr%)? ';' (expr%)? ')' (stmt | ':' top* 'endfor' ';')
  | 'foreach' '(' expr 'as' (expr '=>')? '&'? expr ')' (stmt | ':' top* 'endforeach' ';') | 'switch' '(' expr ')' '{' case* '}' | 'switch' '(' expr ')' ':' case* 'endswitch' ';'
  | 'try' block catch* ('finally' block)? | 'declare' '(' (name '=' expr)% ')' (';' | block) | 'namespace' qname ';' | 'namespace' qname? block
  | 'use' ('function' | 'const')? use_item% ';' | 'use' ('function' | 'const')? qname '\\\\' '{' (use_item%%)? '}' ';' | attr* fn_decl | attr* class_decl | attr* 'const' ctype? const_item%  ';' | name ':' | HTML ;
else : 'else' stmt ;
use_item : ('function' | 'const')? qname ('as' name)? ;
simple : expr | 'echo' expr% | 'print' expr | 'return' expr? | 'break' NUM? | 'continue' NUM? | 'global' VAR% | 'static' (VAR ('=' expr)?)% | 'unset' '(' expr%% ')' | 'goto' name | 'throw' expr ;
case : ('case' expr | 'default') (':' | ';') top* ;
catch : 'catch' '(' qname ('|' qname)* VAR? ')' block ;
block : '{' top* '}' ;
fn_decl : 'function' '&'? fname '(' (param%%)? ')' (':' ctype)? block ;
fname : name | 'list' | 'match' | 'print' | 'echo' ;
attr : '#[' (qname args?)%% ']' ;
param : attr* mods ctype? '&'? '...'? VAR ('=' expr)? hooks? ;
mods : mod* ;
mod : 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'readonly' | 'var' ;
ctype : '?' utype | utype | ctype '|' utype | ctype '&' utype ;
utype : qname | 'static' | 'array' | 'callable' | 'null' | 'self' | '(' ctype ')' ;
class_decl : ('abstract' | 'final' | 'readonly')* 'class' name ('extends' qname)? ('implements' qname%)? body | 'interface' name ('extends' qname%)? body | 'trait' name body | 'enum' name (':' ctype)? ('implements' qname%)? body ;
body : '{' member* '}' ;
member : attr* mods 'const' ctype? const_item% ';' | attr* mods 'function' '&'? mname '(' (param%%)? ')' (':' ctype)? (block | ';') | attr* mod mods ctype? prop% (';' | hooks) | 'use' qname% (';' | '{' adapt* '}') | attr* 'case' name ('=' expr)? ';' ;
adapt : (qname '::')? name ('insteadof' qname% | 'as' mod? name?) ';' ;
hooks : '{' hook* '}' ;
hook : '&'? ID ('(' (param%%)? ')')? ('=>' expr ';' | block | ';') ;
const_item : mname '=' expr ;
prop : VAR ('=' expr)? ;
mname : name | 'class' | 'list' | 'print' | 'echo' | 'default' | 'for' | 'foreach' | 'if' | 'else' | 'while' | 'do' | 'switch' | 'case' | 'return' | 'array' | 'new' | 'clone' | 'static' | 'self' | 'null' | 'use' | 'throw' | 'catch' | 'try' | 'finally' | 'match' | 'fn' | 'function' | 'const' | 'unset' | 'isset' | 'empty' | 'include' | 'require' | 'and' | 'or' | 'xor' | 'as' | 'break' | 'continue' | 'global' | 'goto' | 'exit' | 'public' | 'private' | 'protected' | 'abstract' | 'final' | 'interface' | 'trait' | 'extends' | 'implements' | 'namespace' | 'yield' | 'instanceof' | 'var' | 'eval' | 'callable' | 'declare' ;
name : ID | 'enum' | 'readonly' | 'from' | 'self' | 'null' ;
qname : name | '\\\\' name | 'namespace' '\\\\' name | qname '\\\\' mname ;
expr : unary | expr binop unary | expr '?' expr ':' unary | expr '?' ':' unary | expr 'instanceof' (qname | 'static' | postfix) ;
binop : '+' | '-' | '*' | '/' | '%' | '**' | '.' | '&' | '|' | '^' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '<>' | '<=>' | '&&' | '||' | '??' | '<<' | '>>' | 'and' | 'or' | 'xor' | '|>' ;
unary : postfix | postfix '++' | postfix '--' | ('+' | '-' | '!' | '~' | '@' | '&' | '++' | '--' | CAST | 'clone' | 'print' | 'include' | 'include_once' | 'require' | 'require_once' | 'throw') unary
  | postfix assignop unary | 'new' newclass args? | 'new' attr* mods 'class' args? ('extends' qname)? ('implements' qname%)? body | 'yield' (expr ('=>' expr)?)? | 'yield' 'from' expr | lambda ;
assignop : '=' | '+=' | '-=' | '*=' | '/=' | '.=' | '%=' | '**=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '??=' ;
newclass : qname | 'static' | VAR | newclass '->' member_name | newclass '::' VAR | newclass '[' expr ']' | '(' expr ')' ;
lambda : attr* 'static'? 'function' '&'? '(' (param%%)? ')' ('use' '(' ('&'? VAR)%% ')')? (':' ctype)? block | attr* 'static'? 'fn' '&'? '(' (param%%)? ')' (':' ctype)? '=>' expr ;
postfix : VAR | '$' postfix | '$' '{' expr '}' | NUM | STR | qname | 'static' | '(' expr ')' | '[' (element? ',')* element? ']' | ('array' | 'list') '(' (element? ',')* element? ')' | postfix '[' expr? ']' | postfix '{' expr '}' | postfix ('->' | '?->') member_name | postfix '::' (mname | VAR | '{' expr '}' | '$' postfix) | postfix args
  | 'isset' '(' expr%% ')' | 'empty' '(' expr ')' | 'exit' | 'eval' '(' expr ')' | 'match' '(' expr ')' '{' (match_arm%%)? '}' ;
member_name : mname | VAR | '{' expr '}' ;
args : '(' (arg%%)? ')' | '(' '...' ')' ;
arg : (mname ':')? expr | '...' expr ;
element : expr | expr '=>' expr | '...' expr ;
match_arm : ('default' ','? | expr%%) '=>' expr ;
"""
_PHP = _PHP.replace("postfix '{' expr '}' | postfix ('->'", "postfix ('->'").replace("'\\\\'", "'\\'")

_C_EXPR = """
expr : assign | expr ',' assign ;
assign : cond | unary assignop assign | unary assignop braced ;
assignop : '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' ;
cond : binary | binary '?' expr? ':' assign ;
binop : '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&&' | '||' | '<<' | '>' '>' CPPOPS ;
args : '(' (arg%)? ')' ;
braced : '{' (init_item%%)? '}' ;
init_item : (designator+ '=')? init ;
init : assign | braced ;
designator : '.' ID | '[' cond ('...' cond)? ']' ;
"""

_C = """
file : top* ;
top : fn | decl | ';' | macro_call ;
macro_call : ID '(' (arg%)? ')' ;
fn : spec* fn_declarator knr* block ;
fn_declarator : pointer* fn_direct ;
fn_direct : direct '(' params ')' | direct '(' (ID%)? ')' | '(' attr* fn_declarator ')' | fn_direct '[' assign? ']' | fn_direct '(' params ')' | fn_direct attr ;
knr : decl ;
decl : spec+ (declared%)? ';' | spec* ID ';' | '_Static_assert' '(' cond (',' STR)? ')' ';' ;
declared : declarator asm? attr* ('=' init)? | declarator ':' cond ;
asm : ('asm' | '__asm__') '(' STR+ ')' ;
spec : storage | tspec | attr ;
storage : 'typedef' | 'extern' | 'static' | 'auto' | 'register' | 'inline' | '_Thread_local' | '_Noreturn' | 'const' | 'volatile' | 'restrict' | '_Atomic' | '__inline' | '__restrict' | '__extension__' ;
attr : '__attribute__' '(' '(' (attr_item%)? ')' ')' | '[' '[' attr_item% ']' ']' ;
attr_item : (ID | 'const' | ID '::' ID) args? ;
tspec : 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | '_Bool' | 'bool' | '_Complex' | struct | enum | ID | ('typeof' | '__typeof__') '(' (expr | type_name) ')' ;
struct : ('struct' | 'union') attr* ID? '{' member* '}' attr* | ('struct' | 'union') attr* ID ;
member : spec+ (member_decl%)? ';' | ';' | '_Static_assert' '(' cond (',' STR)? ')' ';' ;
member_decl : declarator attr* | declarator? ':' cond ;
enum : 'enum' attr* ID? '{' enum_item%% '}' | 'enum' ID ;
enum_item : ID attr* ('=' cond)? ;
declarator : pointer* direct ;
pointer : '*' ('const' | 'volatile' | 'restrict' | '__restrict' | attr)* ;
direct : ID | '(' attr* declarator ')' | direct '[' ('static' | 'const' | 'restrict')* (assign | '*')? ']' | direct '(' params ')' | direct '(' (ID%)? ')' ;
params : param (',' param)* (',' '...')? ;
param : spec+ declarator attr* | spec+ abstract? ;
abstract : pointer+ | pointer* abs_direct ;
abs_direct : '(' abstract ')' | abs_direct? '[' ('static' | 'const')* (assign | '*')? ']' | abs_direct? '(' params? ')' ;
type_name : spec+ abstract? ;
block : '{' stmt* '}' ;
stmt : block | ';' | decl | expr ';' | 'if' '(' expr ')' stmt | 'if' '(' expr ')' stmt 'else' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' (expr? ';' | decl) expr? ';' expr? ')' stmt
  | 'switch' '(' expr ')' stmt | 'case' cond ('...' cond)? ':' stmt | 'default' ':' stmt | ID ':' stmt | 'case' cond ':' | 'default' ':' | ID ':' | 'goto' ID ';' | 'break' ';' | 'continue' ';' | 'return' expr? ';' | ('asm' | '__asm__') 'volatile'? '(' asm_part* ')' ';' ;
asm_part : STR | ':' | ',' | '(' expr ')' | '[' ID ']' ;
""" + _C_EXPR.replace(" CPPOPS", "") + """
arg : assign | type_name ;
binary : unary | binary binop unary ;
unary : postfix | ('+' | '-' | '!' | '~' | '*' | '&' | '++' | '--' | '&&') unary | '(' type_name ')' unary | ('sizeof' | '_Alignof' | 'alignof') '(' type_name ')' | 'sizeof' unary ;
postfix : ID | NUM | CHR | STR+ | 'true' | 'false' | '(' expr ')' | '(' block ')' | postfix '[' expr ']' | postfix args | postfix '.' ID | postfix '->' ID | postfix '++' | postfix '--' | '(' type_name ')' braced | STR+ ID STR* | '_Generic' '(' assign ',' generic% ')' ;
generic : (type_name | 'default') ':' assign ;
"""

_CPP = """
file : top* ;
top : decl_or_fn | 'namespace' attr* qid? '{' top* '}' | 'inline' 'namespace' ID '{' top* '}' | 'namespace' ID '=' qid ';' | 'using' 'namespace' qid ';' | 'extern' STR ('{' top* '}' | decl_or_fn) | template top | ';' | concept ;
concept : 'concept' ID '=' expr ';' ;
template : 'template' '<' (tparam%)? '>' requires? | 'template' ;
requires : 'requires' cond ;
tparam : ('typename' | 'class') '...'? ID? ('=' type_name)? | template ('typename' | 'class') '...'? ID? ('=' type_name)? | param ;
decl_or_fn : decl | fn ;
fn : spec* declarator fn_tail block | spec* declarator ctor_init block | spec* declarator fn_tail '=' ('default' | 'delete') ';' | spec* declarator fn_tail 'try' block catch+ ;
fn_tail : fn_mod* ('->' type_name fn_mod*)? requires? ;
fn_mod : 'const' | 'volatile' | 'noexcept' ('(' expr ')')? | 'override' | 'final' | '&' | '&&' | 'throw' '(' (type_name%)? ')' | attr ;
ctor_init : fn_tail ':' mem_init% ;
mem_init : qid (args | braced) '...'? ;
decl : sdecl | declarator fn_tail ('=' init)? ';' ;
sdecl : spec+ (declared%)? ';' | 'using' qid attr* '=' type_name ';' | 'using' 'typename'? qid% ';' | 'static_assert' '(' cond (',' STR+)? ')' ';' | spec+ '[' ID% ']' '=' init ';' ;
declared : declarator fn_tail ('=' init)? | declarator braced | declarator? ':' cond ('=' init)? | declarator '(' (arg%)? ')' ;
spec : 'typedef' | 'extern' | 'static' | 'register' | 'inline' | 'thread_local' | 'const' | 'volatile' | 'constexpr' | 'consteval' | 'constinit' | 'virtual' | 'explicit' ('(' expr ')')? | 'mutable' | 'friend' | tspec | attr ;
attr : '[' '[' attr_item% ']' ']' | '__attribute__' '(' '(' attr_item% ')' ')' | 'alignas' '(' (expr | type_name) ')' ;
attr_item : ID ('::' ID)? args? ;
tspec : 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | 'bool' | 'wchar_t' | 'auto' | 'char8_t' | 'char16_t' | 'char32_t' | class | enum | 'typename'? qid | 'decltype' '(' expr ')' | ('struct' | 'class' | 'union' | 'enum') qid ;
qid : seg | '::' seg | qid '::' 'template'? seg ;
seg : ID | ID targs | '~' ID | 'operator' operator | 'operator' type_name ;
operator : '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '!' | '~' | '<' | '>' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '==' | '!=' | '<=' | '>=' | '<=>' | '&&' | '||' | '++' | '--' | '<<' | '>' '>' | '<<=' | '>' '>=' | '->' | '->*' | ',' | '(' ')' | '[' ']' | 'new' ('[' ']')? | 'delete' ('[' ']')? | STR ID ;
targs : '<' (targ%)? '>' ;
targ : type_name '...'? | tcond '...'? | braced ;
tcond : unary | tcond tbinop unary ;
tbinop : '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '==' | '!=' | '<=' | '>=' | '&&' | '||' ;
class : ('class' | 'struct' | 'union') attr* (qid 'final'?)? (':' base%)? '{' member* '}' ;
base : ('public' | 'private' | 'protected' | 'virtual')* 'typename'? qid '...'? ;
member : ('public' | 'private' | 'protected') ':' | decl_or_fn | template member | ';' | concept ;
enum : 'enum' ('class' | 'struct')? attr* qid? (':' type_name)? '{' (enum_item%%)? '}' | 'enum' ('class' | 'struct') qid (':' type_name)? ;
enum_item : ID attr* ('=' cond)? ;
declarator : pointer* direct ;
pointer : '*' ('const' | 'volatile')* | '&' | '&&' | qid '::' '*' ;
direct : '...'? qid attr* | '(' declarator ')' | direct '[' cond? ']' | direct '(' params? ')' ;
params : param (',' param)* (',' '...')? | '...' ;
param : spec+ declarator fn_mod* ('=' init)? | spec+ abstract? ('=' init)? ;
abstract : pointer+ '...'? | '...' | pointer* abs_direct ;
abs_direct : '(' abstract ')' | abs_direct? '[' cond? ']' | abs_direct? '(' params? ')' fn_mod* ;
type_name : spec+ abstract? ('->' type_name)? ;
block : '{' stmt* '}' ;
stmt : block | ';' | sdecl | expr ';' | 'if' 'constexpr'? '(' head ')' stmt | 'if' 'constexpr'? '(' head ')' stmt 'else' stmt | 'while' '(' head ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' (expr? ';' | sdecl) expr? ';' expr? ')' stmt | 'for' '(' sdecl? spec+ (declarator | ('&' | '&&')? '[' ID% ']') ':' init ')' stmt
  | 'switch' '(' head ')' stmt | 'case' cond ':' | 'default' ':' | ID ':' | attr stmt | 'goto' ID ';' | 'break' ';' | 'continue' ';' | ('return' | 'co_return') (init)? ';' | 'try' block catch+ | 'using' 'namespace' qid ';' | 'co_yield' init ';' ;
head : expr | sdecl expr | spec+ declarator ('=' init | braced) | sdecl spec+ declarator '=' init ;
catch : 'catch' '(' (param | '...') ')' block ;
""" + _C_EXPR.replace(" CPPOPS", " | '<=>' | '.*' | '->*'").replace("| '[' cond ('...' cond)? ']'", "| '[' cond ']'") + """
arg : init '...'? ;
binary : unary | binary binop unary | 'throw' assign? | 'co_await' unary | fold ;
fold : '...' binop unary ;
unary : postfix | ('+' | '-' | '!' | '~' | '*' | '&' | '++' | '--') unary | '(' type_name ')' unary | ('sizeof' | 'alignof') '(' type_name ')' | 'sizeof' unary | 'sizeof' '...' '(' ID ')' | '::'? 'new' args? spec+ pointer* ('[' expr ']')* (args | braced)? | '::'? 'delete' ('[' ']')? unary | lambda ;
lambda : '[' (capture%)? ']' ('<' (tparam%)? '>')? ('(' params? ')')? ('mutable' | 'constexpr')* fn_mod* ('->' type_name)? block ;
capture : '=' | '&' | '&'? ID '...'? | '&'? ID '=' assign | 'this' | '*' 'this' ;
prim : 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | 'bool' | 'void' | 'auto' | 'wchar_t' ;
postfix : qid | NUM ID? | CHR | (STR ID?)+ | 'true' | 'false' | 'nullptr' | 'this' | '(' expr ')' | '(' expr binop '...' ')' | postfix '[' init ']' | postfix args | postfix '.' 'template'? qid | postfix '->' 'template'? qid | postfix '++' | postfix '--' | qid braced | prim+ args | prim+ braced | 'typename' qid (args | braced)
  | ('static_cast' | 'dynamic_cast' | 'const_cast' | 'reinterpret_cast') '<' type_name '>' '(' expr ')' | 'typeid' '(' (expr | type_name) ')' | 'noexcept' '(' expr ')' | 'decltype' '(' expr ')' | 'requires' ('(' params? ')')? '{' requirement* '}' ;
requirement : expr ';' | 'typename' qid ';' | '{' expr '}' 'noexcept'? ('->' type_name)? ';' | 'requires' expr ';' ;
"""

_C_SHARP = """
file : top* ;
using : 'global'? 'using' 'static'? 'unsafe'? qname ';' | 'global'? 'using' name '=' type ';' ;
top : namespace | attr* modifier* type_decl | stmt_top | using | 'extern' 'alias' name ';' | '[' name ':' attr_item%% ']' ;
stmt_top : stmt ;
namespace : 'namespace' qname '{' (using | namespace | attr* modifier* type_decl)* '}' ';'? | 'namespace' qname ';' ;
attr : '[' (name ':')? attr_item%% ']' ;
attr_item : qname args? ;
qname : seg | qname '.' seg | qname '::' seg ;
seg : name targs? ;
targs : '<' (type%)? '>' | '<' ',' + '>' ;
name : ID | 'var' | 'get' | 'set' | 'init' | 'add' | 'remove' | 'value' | 'where' | 'partial' | 'async' | 'await' | 'record' | 'yield' | 'alias' | 'global' | 'when' | 'from' | 'select' | 'group' | 'into' | 'orderby' | 'join' | 'let' | 'on' | 'equals' | 'by' | 'ascending' | 'descending' | 'nameof' | 'dynamic' | 'required' | 'file' | 'scoped' | 'not' | 'and' | 'or' | 'with' | 'managed' | 'unmanaged' | 'notnull' | 'allows' | 'field' ;
modifier : 'public' | 'private' | 'protected' | 'internal' | 'static' | 'readonly' | 'sealed' | 'abstract' | 'virtual' | 'override' | 'new' | 'extern' | 'unsafe' | 'volatile' | 'async' | 'partial' | 'const' | 'fixed' | 'required' | 'file' | 'ref' ;
type_decl : ('class' | 'struct' | 'interface' | 'record' | 'record' 'class' | 'record' 'struct') name tparams? ('(' (param%)? ')')? (':' base%)? constraint* ('{' member* '}' ';'? | ';') | 'enum' name (':' type)? '{' (enum_item%%)? '}' ';'? | 'delegate' type name tparams? '(' (param%)? ')' constraint* ';' ;
base : type args? ;
enum_item : attr* name ('=' expr)? ;
tparams : '<' (attr* ('in' | 'out')? name)% '>' ;
constraint : 'where' name ':' constraint_item% ;
constraint_item : type | 'class' '?'? | 'struct' | 'new' '(' ')' | 'default' | 'allows' 'ref' 'struct' ;
member : attr* modifier* type_decl | attr* modifier* type var% ';' | attr* modifier* 'event' type (var% ';' | mname '{' accessor* '}') | attr* modifier* type mname tparams? '(' (param%)? ')' constraint* fn_body | attr* modifier* name '(' (param%)? ')' (':' ('base' | 'this') args)? fn_body | attr* modifier* '~' name '(' ')' fn_body
  | attr* modifier* type mname '{' accessor+ '}' ('=' expr ';')? | attr* modifier* type mname '=>' expr ';' | attr* modifier* type (qname '.')? 'this' '[' param% ']' ('{' accessor+ '}' | '=>' expr ';') | attr* modifier* type 'operator' 'checked'? op '(' param% ')' fn_body | attr* modifier* ('implicit' | 'explicit') 'operator' type '(' param% ')' fn_body ;
mname : qname ;
op : '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '!' | '~' | '<' | '>' | '==' | '!=' | '<=' | '>=' | '++' | '--' | '<<' | '>' '>' | 'true' | 'false' ;
accessor : attr* modifier* ('get' | 'set' | 'init' | 'add' | 'remove') fn_body ;
fn_body : block | '=>' expr ';' | ';' ;
param : attr* ('this' | 'ref' | 'out' | 'in' | 'params' | 'scoped' | 'readonly')* type name ('=' expr)? ;
type : base_type | type '?' | type rank | type '*' ;
rank : '[' ','* ']' ;
base_type : qname | prim | '(' tuple_item (',' tuple_item)+ ')' | 'void' | 'ref' 'readonly'? type | 'delegate' '*' 'managed'? '<' type% '>' ;
prim : 'int' | 'long' | 'short' | 'byte' | 'sbyte' | 'uint' | 'ulong' | 'ushort' | 'char' | 'bool' | 'float' | 'double' | 'decimal' | 'string' | 'object' ;
tuple_item : type name? ;
var : name ('[' expr ']')? ('=' var_init)? ;
var_init : expr | braces | 'ref' expr | 'stackalloc' base_type? '[' expr? ']' braces? ;
braces : '{' (var_init%%)? '}' ;
block : '{' stmt* '}' ;
stmt : block | ';' | local ';' | attr* fn_mod* type name tparams? '(' (param%)? ')' constraint* (block | '=>' expr ';') | expr_stmt ';' | 'if' '(' expr ')' stmt | 'if' '(' expr ')' stmt 'else' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' (local | expr_stmt%)? ';' expr? ';' (expr_stmt%)? ')' stmt | 'await'? 'foreach' '(' type (name | '(' name% ')') 'in' expr ')' stmt | 'switch' '(' expr ')' '{' section* '}' | 'return' ('ref'? expr)? ';' | 'throw' expr? ';' | 'break' ';' | 'continue' ';' | 'goto' (name | 'case' expr | 'default') ';'
  | 'try' block (catch+ ('finally' block)? | 'finally' block) | 'lock' '(' expr ')' stmt | 'await'? 'using' '(' (local | expr) ')' stmt | 'await'? 'using' local ';' | 'yield' ('return' expr | 'break') ';' | ('checked' | 'unchecked' | 'unsafe') block | 'fixed' '(' local ')' stmt | name ':' stmt ;
fn_mod : 'static' | 'async' | 'unsafe' | 'extern' ;
local : 'const'? type var% ;
section : label+ stmt* ;
label : 'case' pattern ('when' expr)? ':' | 'default' ':' ;
catch : 'catch' ('(' type name? ')')? ('when' '(' expr ')')? block ;
pattern : pat1 | pattern ('and' | 'or') pat1 ;
pat1 : binary | 'not' pat1 | type name | ('<' | '>' | '<=' | '>=') binary | type? '(' (sub%)? ')' name? | type? '{' (sub%%)? '}' name? | '[' (sub%%)? ']' name? | '..' pat1? | 'var' '(' name% ')' | type ;
sub : ((qname) ':')? pattern ;
expr_stmt : assign | call_like | '++' unary | '--' unary | postfix '++' | postfix '--' | 'await' unary | new ;
call_like : postfix args | postfix '?.' chain | postfix '!' ;
assign : unary assignop expr | unary assignop 'ref' expr ;
assignop : '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '??=' ;
expr : cond | assign | lambda | query | 'throw' expr ;
lambda : attr* fn_mod* type? name '=>' lambda_body | attr* fn_mod* type? '(' (lparam%)? ')' '=>' lambda_body | 'async'? 'delegate' ('(' (param%)? ')')? block ;
lparam : param | name ;
lambda_body : expr | block ;
cond : binary | binary '?' expr ':' expr ;
binary : unary | binary binop unary | binary 'is' pattern | binary 'as' type | binary '??' ('throw' expr) | binary '..' unary? | '..' unary? | binary 'switch' '{' (arm%%)? '}' | binary 'with' object_init | binary binop lambda ;
arm : pattern ('when' expr)? '=>' expr ;
binop : '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&&' | '||' | '<<' | '>' '>' | '??' | '>' '>' '>' ;
unary : postfix | ('+' | '-' | '!' | '~' | '++' | '--' | '&' | '*' | '^' | 'await') unary | '(' type ')' unary | postfix '++' | postfix '--' ;
postfix : qname | prim | NUM | STR | CHR | 'true' | 'false' | 'null' | 'this' | 'base' | '(' expr ')' | '(' arg (',' arg)+ ')' | postfix '.' seg | postfix '->' seg | postfix '?.' chain | postfix '?' '[' arg% ']' | postfix '[' arg% ']' | postfix args | postfix '!' | new | 'typeof' '(' type ')' | 'sizeof' '(' type ')' | 'default' ('(' type ')')? | ('checked' | 'unchecked') '(' expr ')' | '[' (collection%%)? ']' | 'stackalloc' base_type? '[' expr? ']' braces? ;
chain : seg ;
collection : expr | '..' expr ;
new : 'new' type args object_init? | 'new' type object_init | 'new' base_type '[' expr% ']' rank* braces? | 'new' type braces | 'new' rank braces | 'new' '{' (anon%%)? '}' | 'new' args object_init? ;
anon : name '=' expr | expr ;
object_init : '{' (init_item%%)? '}' ;
init_item : name '=' (expr | object_init) | '[' arg% ']' '=' expr | expr | '{' expr%% '}' ;
args : '(' (arg%)? ')' ;
arg : (name ':')? ('ref' | 'out' | 'in')? expr | (name ':')? 'out' type name ;
query : 'from' type? name 'in' expr clause* ('select' expr | 'group' expr 'by' expr) ('into' name clause* ('select' expr | 'group' expr 'by' expr))* ;
clause : 'from' type? name 'in' expr | 'let' name '=' expr | 'where' expr | 'join' type? name 'in' expr 'on' expr 'equals' expr ('into' name)? | 'orderby' (expr ('ascending' | 'descending')?)% ;
"""
_C_SHARP = _C_SHARP.replace("'<' ',' + '>'", "'<' ','+ '>'")

GRAMMARS = {
    "python": PYTHON, "javascript": _script(False, True), "typescript": _script(True, False), "tsx": _script(True, True),
    "java": _JAVA, "go": _GO, "rust": _RUST, "php": _PHP, "c": _C, "cpp": _CPP, "c_sharp": _C_SHARP,
}
