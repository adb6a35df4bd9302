"""Lexers and grammars of the languages that can be checked. The grammars are wide: they take what the language takes, and
what only its types or names would forbid."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from plumbline.llm.derivatives import CLOSE, ELSE, NEXT, OPEN, OPEN_NEVER, Grammar

# --- Tokens -------------------------------------------------------------------------------------------------------------

_DIGITS = r"0[xX][0-9a-fA-F_'.]++(?:[pP][+-]?\d++)?\w*+|0[bB][01_']++\w*+|0[oO][0-7_]++\w*+"
_C_NUMBER = _DIGITS + r"|(?:\d[\d_']*+(?:\.(?!\.)[\d_]*+)?|\.\d[\d_]*+)(?:[eE][+-]?\d[\d_]*+)?(?:[a-zA-Z]\w*+)?"
_RUST_NUMBER = _DIGITS + r"|\d[\d_]*+(?:\.\d[\d_]*+|\.(?![.\w]))?(?:[eE][+-]?\d[\d_]*+)?(?:[a-zA-Z]\w*+)?"
_WORD = r"[^\W\d]\w*"


def _lexer(strings: str, operators: str, comments: str, word: str = _WORD, number: str = _C_NUMBER) -> re.Pattern[str]:
    ops = "|".join(re.escape(o) for o in sorted(operators.split(), key=len, reverse=True))
    return re.compile(rf"(?P<ws>[^\S\n]+)|(?P<nl>\n)|(?P<com>{comments})|(?P<str>{strings})|(?P<num>{number})|(?P<word>{word})|(?P<op>{ops})|(?P<err>[\s\S])")


_SLASHES = r"//[^\n]*|/\*[\s\S]*?\*/"
_DQ, _SQ = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
_COMMON = "{ } ( ) [ ] ; , . + - * / % & | ^ ! ~ = < > ? : += -= *= /= %= &= |= ^= <<= == != <= && || ++ --"

_LEX = {
    "javascript": _lexer(f"{_DQ}|{_SQ}", _COMMON + " => ... ?. ?? ??= ** **= === !== && &&= ||= << @ # \\", _SLASHES + r"|\A#![^\n]*", r"[$_\w][$\w]*|#[$_\w][$\w]*"),
    "go": _lexer(rf"{_DQ}|'(?:[^'\\\n]|\\[^\n]{{1,9}}?)+'|`[^`]*`", _COMMON + " := ... <- << &^ &^= >> >>= >= >", _SLASHES),
    "java": _lexer(rf'"""[\s\S]*?"""|{_DQ}|{_SQ}', _COMMON + " -> :: ... @ <<", _SLASHES, r"[$_\w][$\w]*"),
    "rust": _lexer(
        rf"""b?r(?P<h>\#*)"[\s\S]*?"(?P=h)|[bc]?"(?:[^"\\]|\\[\s\S])*"|b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{{2}}|u\{{[0-9a-fA-F_]+\}}|.))'|'{_WORD}(?!')""",
        _COMMON + " -> => :: .. ... ..= @ # $ <<",
        r"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/",
        rf"r\#{_WORD}|{_WORD}",
        _RUST_NUMBER,
    ),
    "c": _lexer(rf'(?:u8|[uUL])?R"(?P<d>[^\s()\\]{{0,16}})\([\s\S]*?\)(?P=d)"|(?:u8|[uUL])?(?:{_DQ}|{_SQ})', _COMMON + " -> :: ... ## # << <=> ->* .* @", _SLASHES),
    "json": re.compile(r'(?P<ws>[ \t\r\n]+)|(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.+-])|(?P<word>true|false|null)(?!\w)|(?P<op>[{}\[\],:])|(?P<err>[\s\S])', re.A),
}
_LEX["typescript"] = _LEX["javascript"]

_KEYWORDS = {
    "javascript": """break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof
        new return super switch this throw try typeof var void while with null true false enum let yield await""",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": """abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if
        implements import instanceof int interface long native new package private protected public return short static strictfp super switch
        synchronized this throw throws transient try void volatile while null true false""",
    "rust": """as break const continue crate else enum extern fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait
        true false type unsafe use where while async await dyn""",
    "c": """break case const continue default do else enum extern for goto if inline register restrict return sizeof static struct switch typedef union
        volatile while char short int long float double signed unsigned void auto""",
    "python": """False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda
        nonlocal not or pass raise return try while with yield""",
}
_KEYWORDS["typescript"] = _KEYWORDS["javascript"]
_KEYWORDS["cpp"] = _KEYWORDS["c"] + """ class namespace template typename using public private protected virtual friend operator new delete this throw try
    catch constexpr noexcept explicit mutable static_cast dynamic_cast const_cast reinterpret_cast decltype static_assert nullptr true false
    typeid consteval constinit alignas thread_local bool wchar_t concept requires co_await co_return co_yield"""
_WORDS = {k: frozenset(v.split()) for k, v in _KEYWORDS.items()}

# --- Grammars -----------------------------------------------------------------------------------------------------------

_JS = """
file : list ;
list : (blocky | end)* (simple (end list)?)? ;
end : ';' | NL ;
block : '{' list '}' ;
body : NL? (block | blocky | simple end? | ';') ;
simple : e | 'break' id? | 'continue' id? | 'return' e? | 'throw' e | 'debugger' | vars | 'import' importing | 'export' exporting ASIMPLE
       | 'do' body end* 'while' '(' e ')' ;
vars : ('var' | 'let' | 'const') bind (',' bind)* ;
bind : target TYPED ('=' a)? ;
target : id | pattern ;
pattern : '[' (','* (('...')? target ('=' a)?) (',' (('...')? target ('=' a)?)?)*)? ']' | '{' (prop1 (',' prop1)* ','?)? '}' ;
prop1 : '...' target | key (':' target)? ('=' a)? ;
importing : STR attrs? | (id | '*' 'as' id) (',' (names | '*' 'as' id))? 'from' STR attrs? | names 'from' STR attrs? ;
attrs : 'with' obj ;
names : '{' (name1 (',' name1)* ','?)? '}' ;
name1 : (word | STR) ('as' (word | STR))? ;
exporting : names ('from' STR attrs?)? | '*' ('as' (word | STR))? 'from' STR attrs? | 'default' a | vars ;
blocky : block | 'if' '(' e ')' body end* ('else' body)? | 'for' 'await'? '(' forhead ')' body | 'while' '(' e ')' body | 'try' block NL? catches
       | 'switch' '(' e ')' '{' (('case' e | 'default') ':' list)* '}' | func | klass | 'export' (func | klass | 'default' (func | klass)) | 'with' '(' e ')' body
       | id ':' body | DECLARED ;
catches : 'catch' ('(' target TYPED ')')? block (NL? 'finally' block)? | 'finally' block ;
forhead : (vars | e)? (';' e? ';' e? | 'in' e) | ('var' | 'let' | 'const') target ('of' a | 'in' e) | a 'of' a ;
func : 'async'? 'function' '*'? id? GENERIC params RETURNS block ;
params : '(' (param (',' param)* ','?)? ')' ;
param : DECO '...'? target OPTIONAL TYPED ('=' a)? ;
klass : DECO KMOD 'class' id? GENERIC ('extends' lhs)? IMPLEMENTS '{' member* '}' ;
member : ';' | NL | block | DECO mkey+ (GENERIC params RETURNS (block | BODYLESS) | OPTIONAL TYPED ('=' a)? (';' | NL)) | DECO mkey+ OPTIONAL TYPED ('=' a)? ;
mkey : '*' | key ;
key : word | STR | NUM | '[' a ']' ;
word : id | KW ;
e : a (',' a)* ;
a : unary tail | 'yield' '*'? a? | 'async'? id '=>' arrow | 'async'? GENERIC parens RETURNS '=>' arrow ;
arrow : block | a ;
tail : (binop unary)* ('?' a ':' a)? (assign a)? ;
unary : ('!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await')* lhs ('++' | '--')? ;
lhs : 'new'* primary post* | 'import' (args | '.' word) post* | 'super' post* ;
post : '.' word | '?.' (word | '[' e ']' | args)? | '[' e ']' | args | template | POSTS ;
args : '(' (arg (',' arg)* ','?)? ')' ;
arg : '...'? a ;
primary : id | NUM | STR | template | REGEX | 'this' | 'null' | 'true' | 'false' | '(' e ')' | arr | obj | func | klass | 'new' '.' word | EMPTY ;
template : TEMPLATE | THEAD e (TMIDDLE e)* TTAIL ;
parens : params ;
arr : '[' (','* arg (',' arg?)*)? ']' | '[' ','+ ']' ;
obj : '{' (prop (',' prop)* ','?)? '}' ;
prop : '...' a | key (':' a)? ('=' a)? | mkey+ GENERIC params RETURNS block ;
binop : '+' | '-' | '*' | '/' | '%' | '**' | '&' | '|' | '^' | '<<' | '>' '>'? '>'? '='? | '<' | '<=' | '==' | '!=' | '===' | '!==' | '&&' | '||' | '??' | 'in' | 'instanceof' ;
assign : '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' ;
id : IDENT | 'async' | 'of' | 'as' | 'from' | 'let' | 'await' | 'yield' TSID ;
"""
_JS_PLAIN = {"ASIMPLE": "", "TYPED": "", "DECLARED": "STOP", "GENERIC": "", "RETURNS": "", "OPTIONAL": "", "KMOD": "", "IMPLEMENTS": "", "BODYLESS": "STOP", "POSTS": "STOP", "EMPTY": "STOP", "DECO": "('@' lhs NL?)*", "TSID": ""}
_TS = {
    "ASIMPLE": "| typealias | 'export' (typealias | '=' e | 'type'? names ('from' STR)?) | 'declare' (vars | typealias | 'async'? 'function' id generic? params returns) | 'import' 'type' importing | 'import' id '=' e | 'async'? 'function' id generic? params returns | 'export' 'default'? 'async'? 'function' id generic? params returns",
    "TYPED": "('!'? ':' type)?",
    "DECLARED": "'export'? 'default'? 'declare'? (interface | enumer | 'namespace' id ('.' id)* block | 'module' (id ('.' id)* | STR) block | 'global' block) | 'export'? 'declare' (func | klass)",
    "GENERIC": "generic?",
    "RETURNS": "returns",
    "OPTIONAL": "('?' | '!')?",
    "KMOD": "'abstract'?",
    "IMPLEMENTS": "('implements' type (',' type)*)?",
    "BODYLESS": "end",
    "POSTS": "targs args | '!' | 'as' type | 'satisfies' type | '[' ']'",
    "EMPTY": "'(' ')' | '<' type '>' unary",
    "DECO": "('@' lhs NL?)* ('public' | 'private' | 'protected' | 'readonly' | 'override')*",
    "TSID": "| 'type' | 'declare' | 'abstract' | 'namespace' | 'module' | 'implements' | 'satisfies' | 'interface' | 'is' | 'keyof' | 'infer' | 'readonly' | 'public' | 'private' | 'protected' | 'override' | 'asserts' | 'global' | 'unique'",
}
_TS_MORE = """
returns : (':' type)? ;
generic : '<' tparam (',' tparam)* ','? '>' ;
tparam : ('const' | 'in' | id)? id ('extends' type)? ('=' type)? ;
typealias : 'type' id generic? '=' type ;
interface : 'interface' id generic? ('extends' type (',' type)*)? members ;
members : '{' (tmember | ';' | ',' | NL)* '}' ;
tmember : ('readonly' | '-' 'readonly' | '+' 'readonly')? (key '?'? (generic? params)? (':' type)? | '[' id ('in' | ':') type ('as' type)? ']' (('-' | '+')? '?')? (':' type)? | generic? params (':' type)? | 'new' generic? params (':' type)? | id key params (':' type)?) ;
enumer : 'const'? 'enum' id '{' (key ('=' a)? (',' key ('=' a)?)* ','?)? '}' ;
type : ('|' | '&')? tunion ('extends' tunion '?' type ':' type)? | generic? params '=>' type | 'abstract'? 'new' generic? params '=>' type | 'asserts'? (id | 'this') 'is' type | 'asserts' (id | 'this') ;
tunion : tpost (('|' | '&') tpost)* ;
tpost : ('keyof' | 'readonly' | 'unique' | 'infer')* tprim ('[' type? ']' | '!')* ;
tprim : (id | 'this' | 'void' | 'null' | 'true' | 'false' | 'import' args | 'typeof' (id | 'this' | 'import' args)) ('.' word)* targs? | STR | TEMPLATE | THEAD type (TMIDDLE type)* TTAIL | '-'? NUM | '(' type ')' | '[' (telem (',' telem)* ','?)? ']' | members ;
telem : '...'? (id '?'? ':')? type '?'? ;
targs : '<' type (',' type)* ','? '>' ;
"""
_GO = """
file : ';'* 'package' IDENT ';' (import ';')* (top ';')* top? ;
import : 'import' (spec | '(' ';'* (spec ';')* spec? ')') ;
spec : ('.' | IDENT)? STR ;
top : func | decl ;
decl : 'var' group1 | 'const' group1 | 'type' (tspec | '(' (tspec ';')* tspec? ')') ;
group1 : vspec | '(' (vspec ';')* vspec? ')' ;
vspec : IDENT (',' IDENT)* type? ('=' e (',' e)*)? ;
tspec : IDENT tparams? '='? type ;
tparams : '[' tp (',' tp)* ','? ']' ;
tp : IDENT (',' IDENT)* constraint ;
constraint : '~'? type ('|' '~'? type)* ;
func : 'func' params? IDENT tparams? sig block? ;
sig : params (params | type)? ;
params : '(' (param (',' param)* ','?)? ')' ;
param : '...'? type | IDENT '...'? type ;
type : IDENT ('.' IDENT)? targs? | '*' type | '[' (e | '...')? ']' type | 'map' '[' type ']' type | '<-'? 'chan' '<-'? type | 'func' sig | 'struct' '{' (field ';')* field? '}'
     | 'interface' '{' (imember ';')* imember? '}' | '(' type ')' ;
targs : '[' type (',' type)* ','? ']' ;
field : (IDENT (',' IDENT)* type | '*'? IDENT ('.' IDENT)? targs?) STR? ;
imember : IDENT sig | constraint ;
block : '{' list '}' ;
list : (stmt? ';')* stmt? ;
stmt : decl | simple | 'return' es? | 'break' IDENT? | 'continue' IDENT? | 'goto' IDENT | 'fallthrough' | 'go' e | 'defer' e | block | ifs | 'for' (forhead)? block
     | 'switch' (hsimple? ';')? (hsimple)? '{' (('case' (e | type) (',' (e | type))* | 'default') ':' list)* '}' | 'select' '{' (('case' simple | 'default') ':' list)* '}' | IDENT ':' stmt? | IDENT ':' ;
ifs : 'if' (hsimple? ';')? h block ('else' (ifs | block))? ;
forhead : h | hsimple? ';' h? ';' hsimple? | (hs (':=' | '='))? 'range' h ;
simple : es (asg es | '++' | '--' | '<-' e)? ;
hsimple : hs (asg hs | '++' | '--' | '<-' h)? ;
asg : '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ;
es : e (',' e)* ;
hs : h (',' h)* ;
e : unary (binop unary)* ;
h : hunary (binop hunary)* ;
unary : pre* operand (post | lit)* ;
hunary : pre* (operand post* | complex lit post*) ;
pre : '-' | '+' | '!' | '^' | '*' | '&' | '<-' ;
operand : IDENT | NUM | STR | '(' (e | type) ')' | 'func' sig block | complex (lit | '(' e ','? ')') ;
complex : '[' (e | '...')? ']' type | 'map' '[' type ']' type | 'struct' '{' (field ';')* field? '}' | 'interface' '{' (imember ';')* imember? '}' | 'chan' type ;
post : '.' (IDENT | '(' (type | 'type') ')') | '[' (ix (',' ix)* ','?)? ']' | '[' e? ':' e? (':' e)? ']' | '(' (arg (',' arg)* ','?)? ')' ;
ix : e | type ;
arg : e '...'? | complex | 'func' sig | 'interface' '{' '}' ;
lit : '{' (elem (',' elem)* ','?)? '}' ;
elem : (e | lit) (':' (e | lit))? ;
binop : '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>>' | '&^' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '&&' | '||' ;
"""
_JAVA = """
file : (anno* 'package' name ';')? (('import' 'static'? id ('.' id)* ('.' '*')? ';') | ';')* (typedecl | ';')* ;
name : id ('.' id)* ;
anno : '@' name ('(' (annoval (',' annoval)* ','?)? ')')? ;
annoval : id '=' aval | aval ;
aval : e | anno | '{' (aval (',' aval)* ','?)? '}' ;
mods : (anno | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | SEALED)* ;
typedecl : mods (klass | 'interface' id tparams? ('extends' types)? ('permits' types)? kbody | 'enum' id ('implements' types)? '{' enums? (';' member*)? '}' | '@' 'interface' id kbody | 'record' id tparams? fparams ('implements' types)? kbody) ;
klass : 'class' id tparams? ('extends' type)? ('implements' types)? ('permits' types)? kbody ;
kbody : '{' member* '}' ;
enums : enum1 (',' enum1)* ','? | ',' ;
enum1 : anno* id args? kbody? ;
member : ';' | 'static'? block | typedecl | mods tparams? (('void' | type) id fparams dims throws? (block | ('default' aval)? ';') | id fparams? throws? block | type vars ';') ;
throws : 'throws' types ;
fparams : '(' (fparam (',' fparam)* ','?)? ')' ;
fparam : ('final' | anno)* type '...'? (id | 'this') dims ;
tparams : '<' (anno* id ('extends' type ('&' type)*)?) (',' (anno* id ('extends' type ('&' type)*)?))* '>' ;
types : type (',' type)* ;
type : anno* (prim | id targs? ('.' anno* id targs?)*) dims ;
prim : 'boolean' | 'byte' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' ;
targs : '<' (targ (',' targ)*)? '>' ;
targ : type | anno* '?' (('extends' | 'super') type)? ;
dims : (anno* '[' ']')* ;
vars : var1 (',' var1)* ;
var1 : id dims ('=' init)? ;
init : e | '{' (init (',' init)* ','?)? '}' ;
block : '{' stmt* '}' ;
stmt : ';' | block | ('final' | anno)* type vars ';' | ('final' | 'abstract' | 'static' | anno)* klass | 'interface' id kbody | 'record' id tparams? fparams kbody | 'enum' id '{' enums? (';' member*)? '}' | e ';' | 'if' '(' e ')' stmt ('else' stmt)?
     | 'while' '(' e ')' stmt | 'do' stmt 'while' '(' e ')' ';' | 'for' '(' fhead ')' stmt | 'return' e? ';' | 'break' id? ';' | 'continue' id? ';' | 'throw' e ';'
     | 'try' ('(' res (';' res)* ';'? ')')? block ('catch' '(' ('final' | anno)* type ('|' type)* id ')' block)* ('finally' block)? | switch
     | 'synchronized' '(' e ')' block | 'assert' e (':' e)? ';' | id ':' stmt | 'yield' e ';' ;
res : ('final' | anno)* type id '=' e | e ;
fhead : (('final' | anno)* type vars | e (',' e)*)? ';' e? ';' (e (',' e)*)? | ('final' | anno)* type id ':' e ;
switch : 'switch' '(' e ')' '{' case* '}' ;
case : ('case' label (',' label)* ('when' e)? | 'default') (':' stmt* | '->' (e ';' | block | 'throw' e ';')) ;
label : e | type id | 'default' | 'null' ;
e : unary (binop unary)* ('instanceof' 'final'? type id?)? (binop unary)* ('?' e ':' e)? (asg e)? | id '->' (e | block) | '(' (id (',' id)*)? ')' '->' (e | block) | fparams '->' (e | block) ;
unary : ('!' | '~' | '+' | '-' | '++' | '--')* primary post* ('++' | '--')? ;
primary : id | NUM | STR | 'this' | 'super' | 'null' | 'true' | 'false' | '(' e ')' | '(' type ('&' type)* ')' cast | 'new' anno* create | prim dims ('.' 'class' | '::' 'new') | 'void' '.' 'class' | switch | id targs? dims '::' (id | 'new') | id ('[' ']')+ '.' 'class' ;
cast : unary | id '->' (e | block) | '(' (id (',' id)*)? ')' '->' (e | block) ;
create : ctype (args kbody? | ('[' e ']')+ dims | ('[' ']')+ '{' (init (',' init)* ','?)? '}') ;
ctype : prim | id targs? ('.' id targs?)* ;
post : '.' targs? (id | 'this' | 'class' | 'super' | 'new' create) | '[' e ']' | args | '::' targs? (id | 'new') ;
args : '(' (e (',' e)*)? ')' ;
binop : '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>' '>'? '>'? '='? | '<' | '<=' | '==' | '!=' | '&&' | '||' ;
asg : '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' ;
id : IDENT | 'record' | 'permits' | 'when' | 'yield' | SEALEDWORD ;
"""
_RUST = """
file : innerattr* item* ;
innerattr : '#' '!' '[' tts ']' ;
attr : '#' '[' tts ']' ;
tts : tt* ;
tt : '(' tts ')' | '[' tts ']' | '{' tts '}' | ANY ;
vis : ('pub' ('(' ('crate' | 'self' | 'super' | 'in' path) ')')?)? ;
item : attr* vis (fn | 'struct' id generics? (where? '{' (sfield (',' sfield)* ','?)? '}' | '(' (tfield (',' tfield)* ','?)? ')' where? ';' | where? ';') | 'union' id generics? where? '{' (sfield (',' sfield)* ','?)? '}'
     | 'enum' id generics? where? '{' (variant (',' variant)* ','?)? '}' | 'unsafe'? 'impl' generics? ('!'? type 'for')? type where? '{' innerattr* item* '}' | 'unsafe'? 'trait' id generics? (':' bounds?)? where? '{' item* '}'
     | 'use' usetree ';' | 'unsafe'? 'mod' id (';' | '{' innerattr* item* '}') | 'const' (id | '_') (':' type)? ('=' e)? ';' | 'static' 'mut'? id ':' type ('=' e)? ';' | 'type' id generics? (':' bounds?)? where? ('=' type)? where? ';'
     | 'extern' 'crate' (id | 'self') ('as' (id | '_'))? ';' | 'unsafe'? 'extern' STR? '{' innerattr* item* '}' | macroitem) ;
macroitem : path '!' id? ('{' tts '}' | '(' tts ')' ';' | '[' tts ']' ';') ;
fn : ('const' | 'async' | 'unsafe' | 'extern' STR?)* 'fn' id generics? '(' (fnarg (',' fnarg)* ','?)? ')' ('->' type)? where? (block | ';') ;
fnarg : attr* ('&' LIFETIME? 'mut'? 'self' | 'mut'? 'self' (':' type)? | pat ':' type | '...' | type) ;
generics : '<' (gparam (',' gparam)* ','?)? '>' ;
gparam : attr* (LIFETIME (':' LIFETIME? ('+' LIFETIME)*)? | id (':' bounds?)? ('=' type)? | 'const' id ':' type ('=' e0)?) ;
e0 : '-'? NUM | STR | 'true' | 'false' | block | id ;
where : 'where' (wpred (',' wpred)* ','?)? ;
wpred : LIFETIME ':' bounds? | ('for' generics)? type ':' bounds? ;
bounds : bound ('+' bound)* '+'? ;
bound : LIFETIME | '?'? ('for' generics)? path | '(' '?'? ('for' generics)? path ')' | '~'? 'const' path ;
sfield : attr* vis id ':' type ;
tfield : attr* vis type ;
variant : attr* vis id ('{' (sfield (',' sfield)* ','?)? '}' | '(' (tfield (',' tfield)* ','?)? ')')? ('=' e)? ;
usetree : '::'? useseg ('::' useseg)* ('::' ('*' | '{' (usetree (',' usetree)* ','?)? '}'))? ('as' (id | '_'))? | '::'? ('*' | '{' (usetree (',' usetree)* ','?)? '}') ;
useseg : id | 'crate' | 'self' | 'super' ;
type : '&' LIFETIME? 'mut'? type1 | ('*' ('const' | 'mut')) type1 | '(' (type (',' type)* ','?)? ')' | '[' type (';' e)? ']' | '!' | '_' | ('dyn' | 'impl') bounds | ('for' generics)? ('unsafe' | 'extern' STR?)* 'fn' '(' (ftarg (',' ftarg)* ','?)? ')' ('->' type)? | path ('!' tt)? | '<' type ('as' path)? '>' ('::' seg)+ | '&&' LIFETIME? 'mut'? type1 ;
type1 : type ;
ftarg : (id ':')? type | '...' ;
path : '::'? seg ('::' seg)* ;
seg : (id | 'crate' | 'self' | 'Self' | 'super') (targs | '::' targs | '(' (type (',' type)* ','?)? ')' ('->' type)?)? ;
targs : '<' (targ (',' targ)* ','?)? '>' ;
targ : LIFETIME | type | '-'? NUM | block | id targs? ('=' type | ':' bounds) | STR | 'true' | 'false' ;
block : '{' innerattr* stmts '}' ;
stmts : (';' | item | attr* let | blocky | attr* e ';')* (attr* e)? ;
let : 'let' pat (':' type)? ('=' e ('else' block)?)? ';' ;
blocky : (LIFETIME ':')? (block | ('unsafe' | 'async' 'move'? | 'const') block | ifx | 'match' h '{' innerattr* arm* '}' | 'while' cond block | 'loop' block | 'for' pat 'in' h block) | path '!' '{' tts '}' ;
ifx : 'if' cond block ('else' (ifx | block))? ;
cond : h ;
arm : attr* '|'? pat ('if' e)? '=>' (e ',' | e | blocky ','?) ;
pat : patone ('|' patone)* ;
patone : '_' | '..' | ('ref' | 'mut')* id ('@' patone)? | lit (('..=' | '..' | '...') lit?)? | ('..=' | '..') lit | '&' 'mut'? patone | '&&' 'mut'? patone | '(' (pat (',' pat)* ','?)? ')' | '[' (pat (',' pat)* ','?)? ']' | epath ('(' (pat (',' pat)* ','?)? ')' | '{' (fpat (',' fpat)* ','?)? '}' | ('..=' | '..') (lit | epath)?)? | path '!' tt | 'box' patone | 'const' block ;
fpat : attr* ('..' | ('ref' | 'mut')* (id | NUM) (':' pat)?) ;
lit : '-'? NUM | STR | 'true' | 'false' ;
epath : '::'? eseg ('::' (eseg | targs))* | '<' type ('as' path)? '>' ('::' (eseg | targs))+ ;
eseg : id | 'crate' | 'self' | 'Self' | 'super' ;
e : range (asg e)? | closure | jump ;
h : hrange (asg h)? | closure | jump ;
closure : ('for' generics)? ('static' | 'async' | 'move')* ('||' | '|' (carg (',' carg)* ','?)? '|') ('->' type block | e) ;
carg : attr* patone (':' type)? ;
jump : 'return' e? | 'break' LIFETIME? e? | 'continue' LIFETIME? ;
range : bin (('..' | '..=') bin?)? | ('..' | '..=') bin? ;
hrange : hbin (('..' | '..=') hbin?)? | ('..' | '..=') hbin? ;
bin : un (binop (un | closure | jump))* ;
hbin : hun (binop (hun | closure | jump))* ;
un : pre* (base | epath '{' (finit (',' finit)* ','?)? ('..' e)? '}') post* ;
hun : pre* base post* ;
finit : attr* (id | NUM) (':' e)? | '..' e? ;
pre : '-' | '!' | '*' | '&' ('raw' 'const' | 'mut')? | '&&' 'mut'? | 'let' pat '=' ;
base : NUM | STR | 'true' | 'false' | epath | path '!' ('(' tts ')' | '[' tts ']' | '{' tts '}') | '(' (attr* e (',' e)* ','?)? ')' | '[' (e (';' e | (',' e)* ','?))? ']' | blocky2 ;
blocky2 : (LIFETIME ':')? (block | ('unsafe' | 'async' 'move'? | 'const') block | ifx | 'match' h '{' innerattr* arm* '}' | 'while' cond block | 'loop' block | 'for' pat 'in' h block) ;
post : '.' (id ('::' targs)? | NUM | 'await') | '(' (e (',' e)* ','?)? ')' | '[' e ']' | '?' | 'as' type ;
binop : '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>' '>'? '='? | '<' | '<=' | '==' | '!=' | '&&' | '||' ;
asg : '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' ;
id : IDENT | 'union' | 'raw' | 'box' ;
"""
_C = """
file : ext* ;
ext : ';' | attr* decl | CPPEXT | 'extern' STR ('{' ext* '}' | ext) | asm ';' ;
asm : ASM '(' tts ')' ;
tts : tt* ;
tt : '(' tts ')' | '[' tts ']' | '{' tts '}' | ANY ;
attr : '[' '[' tts ']' ']' | ATTR ('(' tts ')')? ;
decl : spec+ (';' | dtor1 (';' | '=' init (',' dinit)* ';' | (',' dinit)+ ';')) | spec* fdtor (';' | FBODY) ;
dinit : dtor1 ('=' init)? ;
spec : 'typedef' | 'extern' | 'static' | 'inline' | 'register' | 'auto' | const | prim | attr | tag | tname CPPSPEC ;
const : 'const' | 'volatile' | 'restrict' ;
prim : 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' ;
tname : CPPNAME ;
tag : ('struct' | 'union' | CPPKLASS) attr* (tname FINAL? BASES)? ('{' KMEMBER* '}')? | 'enum' (CPPENUM)? attr* tname? (':' spec+)? ('{' (IDENT attr* ('=' cond)? (',' IDENT attr* ('=' cond)?)* ','?)? '}')? ;
member : ';' | attr* spec+ (';' | mdtor (',' mdtor)* ';') ;
mdtor : dtor1 (':' cond)? ('=' init)? | ':' cond ;
ptr : '*' const* | '&' | '&&' PTRMORE ;
dtor1 : ptr* attr* (tname | '(' dtor1 ')') (suffix | '(' params ')' fmods)* CPPINIT ;
fdtor : ptr* attr* (FNAME | '(' ptr+ dtor1 ')') '(' params ')' fmods ;
suffix : '[' 'static'? const* cond? ']' ;
params : (param (',' param)*)? (','? '...')? ;
param : attr* spec+ adtor? ('=' init)? ;
adtor : ptr+ (tname | '(' adtor ')')? (suffix | '(' params ')' const*)* | tname (suffix | '(' params ')')* | suffix+ | '(' (adtor | params) ')' (suffix | '(' params ')')* | PACK ;
fmods : FMODS ;
init : a | '{' (ielem (',' ielem)* ','?)? '}' ;
ielem : (('.' IDENT | '[' cond ']')+ '='?)? init PACKED ;
block : '{' stmt* '}' ;
stmt : ';' | block | attr* decl | e ';' | 'if' CONSTEXPR '(' CPPCOND ')' stmt ('else' stmt)? | 'while' '(' CPPCOND ')' stmt | 'do' stmt 'while' '(' e ')' ';' | 'for' '(' fhead ')' stmt | 'switch' '(' CPPCOND ')' stmt
     | 'case' cond ('...' cond)? ':' | 'default' ':' | IDENT ':' | 'goto' IDENT ';' | 'break' ';' | 'continue' ';' | 'return' (e | '{' (ielem (',' ielem)* ','?)? '}')? ';' | asm ';' | CPPSTMT ;
fhead : (attr* decl | e? ';') e? ';' e? CPPFOR ;
tid : spec+ adtor? ;
e : a (',' a)* ;
a : cond (asg init)? CPPTHROW ;
cond : un (binop un)* ('?' e? ':' a)? ;
un : ('+' | '-' | '!' | '~' | '*' | '&' | '&&' | '++' | '--')* (post1 | 'sizeof' ('(' tid ')' | PACKSIZE un) | '(' tid ')' (un | '{' (ielem (',' ielem)* ','?)? '}') | CPPUN) ;
post1 : prime ('[' e ']' | '(' (init PACKED (',' init PACKED)*)? ')' | ('.' | '->' | ARROWSTAR) MEMBERNAME | '++' | '--' BRACED)* ;
prime : CPPID | NUM | STR+ | '(' e ')' | '(' block ')' | CPPPRIME ;
binop : '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>' '>'? '='? | '<' | '<=' | '==' | '!=' | '&&' | '||' MOREOPS ;
asg : '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' ;
"""
_C_PLAIN = {
    "CPPEXT": "STOP", "CPPSPEC": "", "CPPNAME": "IDENT", "CPPKLASS": "STOP", "FINAL": "STOP", "BASES": "", "KMEMBER": "member", "CPPENUM": "STOP", "PTRMORE": "STOP", "CPPINIT": "", "FNAME": "IDENT", "PACK": "STOP", "FMODS": "attr*",
    "PACKED": "", "CONSTEXPR": "", "CPPCOND": "e", "CPPSTMT": "STOP", "CPPFOR": "", "CPPTHROW": "", "CPPUN": "STOP", "ARROWSTAR": "STOP", "MEMBERNAME": "IDENT", "BRACED": "", "CPPID": "IDENT", "CPPPRIME": "STOP", "MOREOPS": "", "FBODY": "block", "PACKSIZE": "", "ASM": "ASM", "ATTR": "ATTR",
}
_CPP = {
    "CPPEXT": "'inline'? 'namespace' attr* (IDENT ('::' 'inline'? IDENT)*)? ('{' ext* '}' | '=' qname ';') | template ext | 'using' using ';' | 'static_assert' '(' a (',' a)? ')' ';' | 'template' ext | 'concept' IDENT '=' cond ';' | 'friend' ext",
    "CPPSPEC": "| 'virtual' | 'explicit' ('(' a ')')? | 'friend' | 'mutable' | 'constexpr' | 'consteval' | 'constinit' | 'thread_local' | 'alignas' '(' (tid | a) ')' | 'bool' | 'wchar_t' | 'typename' qname | 'decltype' '(' e ')' | 'auto' | attr",
    "CPPNAME": "qname",
    "CPPKLASS": "'class'",
    "FINAL": "FINALWORD",
    "BASES": "(':' base (',' base)*)?",
    "KMEMBER": "kmember",
    "CPPENUM": "'class' | 'struct'",
    "PTRMORE": "| qname '::' '*' const*",
    "CPPINIT": "('{' (ielem (',' ielem)* ','?)? '}' | '(' (init (',' init)*)? ')')?",
    "FNAME": "(qname | '~' IDENT | (qname '::')? ('operator' opname | '~' IDENT))",
    "PACK": "'...' tname?",
    "FMODS": "(const | '&' | '&&' | 'noexcept' ('(' a ')')? | IDENT | '->' tid | 'throw' '(' tts ')' | attr | 'requires' cond)*",
    "PACKED": "'...'?",
    "CONSTEXPR": "'constexpr'?",
    "CPPCOND": "(e | (decl)? spec+ dtor1 '=' init | (decl | e ';') e)",
    "CPPSTMT": "'try' block handler+ | 'using' using ';' | 'static_assert' '(' a (',' a)? ')' ';' | 'namespace' IDENT '=' qname ';' | 'co_return' e? ';'",
    "CPPFOR": "| decl? attr* spec+ ptr* (IDENT | '[' IDENT (',' IDENT)* ']') ':' init",
    "CPPTHROW": "| 'throw' a? | 'co_yield' init",
    "CPPUN": "'new' ('(' a (',' a)* ')')? (spec+ ptr* ('[' e ']')* | '(' tid ')') ('(' (init PACKED1 (',' init PACKED1)*)? ')' | '{' (ielem (',' ielem)* ','?)? '}')? | 'delete' ('[' ']')? un | 'noexcept' '(' a ')' | 'co_await' un",
    "ARROWSTAR": "'->*' | '.*'",
    "MEMBERNAME": "('template'? qname | '~' IDENT | 'operator' opname)",
    "BRACED": "| '{' (ielem (',' ielem)* ','?)? '}'",
    "CPPID": "qname",
    "CPPPRIME": "'this' | 'true' | 'false' | 'nullptr' | lambda | prim ('(' a? ')' | '{' a? '}') | ('static_cast' | 'dynamic_cast' | 'const_cast' | 'reinterpret_cast') '<' tid '>' '(' e ')' | 'typeid' '(' (tid | e) ')' | 'decltype' '(' e ')' | 'operator' opname | 'typename' qname | 'bool' ('(' a ')' | '{' a '}') | '(' un binop '...' (binop un)? ')' | '(' '...' binop un ')'",
    "MOREOPS": "| '<=>' | '->*' | '.*'",
    "FBODY": "((':' minit (',' minit)*)? (block | 'try' block handler+) | '=' ('default' | 'delete' | NUM) ';')",
    "PACKSIZE": "('...' | )",
    "ASM": "ASM", "ATTR": "ATTR",
}
_CPP_MORE = """
qname : '::'? qseg ('::' 'template'? qseg)* ;
qseg : IDENT targs? ;
targs : '<' (targ (',' targ)*)? '>' ;
targ : tid '...'? | un1 '...'? ;
un1 : '-'? NUM | STR | 'true' | 'false' | 'nullptr' | 'sizeof' '(' tid ')' | '(' e ')' | '&' qname ;
template : 'template' '<' (tparam (',' tparam)*)? '>' ('requires' cond)? ;
tparam : ('typename' | 'class') '...'? IDENT? ('=' tid)? | template ('typename' | 'class') '...'? IDENT? ('=' qname)? | param ;
using : 'namespace' qname | 'typename'? qname ('=' tid)? | IDENT attr* '=' tid ;
base : attr* ('virtual' | 'public' | 'private' | 'protected')* qname '...'? ;
kmember : member | ('public' | 'private' | 'protected' | IDENT) ':' | attr* decl | template kmember | 'using' using ';' | 'friend' ext | 'static_assert' '(' a (',' a)? ')' ';' ;
minit : qname ('(' (init (',' init)*)? ')' | '{' (ielem (',' ielem)* ','?)? '}') '...'? ;
handler : 'catch' '(' (spec+ adtor? | '...') ')' block ;
lambda : '[' (cap (',' cap)*)? ']' ('<' (tparam (',' tparam)*)? '>')? ('(' params ')')? ('mutable' | 'constexpr' | 'noexcept' | attr)* ('->' tid)? block ;
cap : '=' | '&' | '&'? '...'? IDENT ('=' init)? '...'? | '*'? 'this' ;
opname : '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '!' | '~' | '=' | '<' | '>' '>'? '='? | '<=' | '==' | '!=' | '<=>' | '&&' | '||' | '<<' | '<<=' | '++' | '--' | ',' | '->' | '->*' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '(' ')' | '[' ']' | 'new' ('[' ']')? | 'delete' ('[' ']')? | 'bool' | STR IDENT | spec+ ptr* ;
"""
_PYTHON = """
file : (NEWLINE | stmt)* ;
stmt : simple (';' simple)* ';'? NEWLINE | compound ;
block : NEWLINE INDENT stmt+ DEDENT | simple (';' simple)* ';'? NEWLINE ;
simple : target | 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' (t ('from' t)?)? | 'global' id (',' id)* | 'nonlocal' id (',' id)* | 'del' stars | 'assert' t (',' t)?
       | 'import' dotted ('as' id)? (',' dotted ('as' id)?)* | 'from' ('.' | '...')* dotted? 'import' ('*' | '(' imp (',' imp)* ','? ')' | imp (',' imp)*) | 'type' id tparams? '=' t ;
imp : id ('as' id)? ;
dotted : id ('.' id)* ;
target : stars (('=' (stars | yield))+ | aug (stars | yield) | ':' t ('=' (stars | yield))?)? | yield ;
stars : star (',' star)* ','? ;
star : '*' or | named ;
aug : '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '**=' | '@=' | '&=' | '|=' | '^=' | '<<=' | '>>=' ;
compound : 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)? | 'while' named ':' block ('else' ':' block)? | 'async'? 'for' stars0 'in' stars ':' block ('else' ':' block)?
         | 'try' ':' block ('finally' ':' block | ('except' '*'? (t (',' t)* ('as' id)?)? ':' block)+ ('else' ':' block)? ('finally' ':' block)?) | 'async'? 'with' withs ':' block | deco* (func | klass) | match ;
withs : with1 (',' with1)* | '(' with1 (',' with1)* ','? ')' ;
with1 : t ('as' prim0)? ;
stars0 : star0 (',' star0)* ','? ;
star0 : '*'? prim0 ;
prim0 : atom post* ;
deco : '@' named NEWLINE ;
func : 'async'? 'def' id tparams? '(' params? ')' ('->' stars)? ':' block ;
klass : 'class' id tparams? ('(' args? ')')? ':' block ;
tparams : '[' tparam (',' tparam)* ','? ']' ;
tparam : ('*' | '**')? id (':' t)? ('=' t)? ;
params : param (',' param)* ','? ;
param : id (':' t)? ('=' t)? | '/' | '*' (id (':' star)?)? | '**' id (':' t)? ;
lparams : lparam (',' lparam)* ','? ;
lparam : id ('=' t)? | '/' | '*' id? | '**' id ;
named : t (':=' t)? ;
t : or ('if' or 'else' t)? | 'lambda' lparams? ':' t ;
or : un (binop un)* ;
un : ('not' | '-' | '+' | '~')* 'await'? atom post* ;
binop : 'or' | 'and' | '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' 'not'? | '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' ;
atom : id | NUM | string+ | 'None' | 'True' | 'False' | '...' | '(' (yield | star (comp | (',' star)* ','?))? ')' | '[' (star (comp | (',' star)* ','?))? ']' | '{' (pair (comp | (',' pair)* ','?))? '}' ;
string : STR | FSTART field* FEND ;
field : FOPEN (yield | stars) '='? ('!' id)? (FSPEC field*)? FCLOSE ;
pair : star (':' t)? | '**' or ;
comp : 'async'? 'for' stars0 'in' or ('if' or0)* comp? ;
or0 : t (':=' t)? ;
yield : 'yield' ('from' t | stars?) ;
post : '.' id | '(' args? ')' | '[' sub (',' sub)* ','? ']' ;
args : arg (',' arg)* ','? ;
arg : named comp? | id '=' t | '*' t | '**' t ;
sub : star | t? ':' t? (':' t?)? ;
match : 'match' stars ':' NEWLINE INDENT (('case' pats ('if' named)? ':' block))+ DEDENT ;
pats : pat (',' pat)* ','? ;
pat : '*'? (or | id ':=' or) ('as' id)? ;
id : IDENT | 'match' | 'case' | 'type' ;
"""
_JSON = "file : value ; value : STR | NUM | 'true' | 'false' | 'null' | '{' (STR ':' value (',' STR ':' value)*)? '}' | '[' (value (',' value)*)? ']' ;"
_TOML = """
file : NEWLINE* (line (NEWLINE+ line)* NEWLINE*)? ;
line : key '=' value | '[' key ']' | '[[' key ']]' ;
key : simple ('.' simple)* ;
simple : BARE | STR ;
value : STR | MLSTR | SCALAR | '[' NEWLINE* (value NEWLINE* (',' NEWLINE* value NEWLINE*)* (',' NEWLINE*)?)? ']' | '{' (key '=' value (',' key '=' value)*)? '}' ;
"""


def _fill(text: str, parts: dict[str, str]) -> str:
    """Puts the parts in the place of their names; STOP is a token that never comes."""
    for _ in range(2):
        text = re.sub(r"\b[A-Z][A-Z0-9]+\b", lambda m: parts.get(m[0], m[0]), text)
    return text


@lru_cache(16)
def grammar(language: str) -> Grammar:
    """The grammar of a language; one for each worker process, whose memo serves all files."""
    if language in ("javascript", "typescript"):
        words = sorted(_WORDS["javascript"])
        kw = "KW0 : " + " | ".join(f"'{w}'" for w in words) + " ;"
        body = _fill(_JS, _JS_PLAIN if language == "javascript" else _TS).replace("KW ;", "kw ;")
        return Grammar(body + kw.replace("KW0", "kw") + (_TS_MORE if language == "typescript" else ""))
    if language == "go":
        return Grammar(_GO)
    if language == "java":
        return Grammar(re.sub(r"\bSEALED\b", "SEALEDWORD", _JAVA))
    if language == "rust":
        g = Grammar(_RUST.replace("ANY", "any") + "any : " + " | ".join(f"'{w}'" for w in _any_tokens("rust")) + " | IDENT | NUM | STR | LIFETIME ;")
        return g
    if language in ("c", "cpp"):
        parts = _C_PLAIN if language == "c" else {**_CPP, "PACKED1": "'...'?"}
        text = _fill(_C, parts) + (_CPP_MORE if language == "cpp" else "")
        return Grammar(text.replace("ANY", "any") + "any : " + " | ".join(f"'{w}'" for w in _any_tokens(language)) + " | IDENT | NUM | STR ;")
    return Grammar({"python": _PYTHON, "json": _JSON, "toml": _TOML}[language])


def _any_tokens(language: str) -> list[str]:
    ops = {"rust": _COMMON + " -> => :: .. ... ..= @ # $ << _ union raw box", "c": _COMMON + " -> ... ## # <<", "cpp": _COMMON + " -> :: ... ## # << <=> ->* .*"}[language]
    return sorted((set(ops.split()) | _WORDS[language]) - set("(){}[]"))


# --- From text to tokens -----------------------------------------------------------------------------------------------

Tokens = list[tuple[str | int, int]]
#: Kinds that end an expression, after which a line break may end a statement.
_ENDS = {"IDENT", "NUM", "STR", "TEMPLATE", "TTAIL", "REGEX", ")", "]", "}", "this", "null", "true", "false", "super", "return", "break", "continue", "++", "--", "debugger", "async", "of", "as", "from", "let", "yield", "await"}
_GOES_ON = {".", "?.", ",", ";", ")", "]", "}", ":", "?", "(", "[", "{", "=", "=>", "in", "instanceof", "else", "catch", "finally", "TEMPLATE", "THEAD", "TMIDDLE", "TTAIL", "*", "/", "%", "+", "-", "<", ">", "&", "|", "^", "**", "==", "!=", "===", "!==", "<=", "&&", "||", "??", "<<", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", "**=", "&&=", "||=", "??=", "as", "satisfies", "extends", "implements", "from"}
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[A-Za-z]*")
_TS_SOFT = frozenset("type declare abstract namespace module implements satisfies interface is keyof infer readonly public private protected override asserts global unique".split())


_TEMPLATE_TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(?P<end>`|\$\{)?")


def _js_tokens(text: str, language: str) -> Tokens:
    """Tokens of JavaScript and TypeScript, with NL where a line break may end a statement. The expressions within a template
    are tokens like others, between THEAD, TMIDDLE and TTAIL."""
    lex, words = _LEX["javascript"], _WORDS["javascript"]
    soft = {"async", "of", "as", "from"} | (_TS_SOFT if language == "typescript" else set())
    out: Tokens = []
    nest: list[str] = []  # what each open brace is: { of code or $ of a template
    i, n, prev, broke = 0, len(text), "", False
    while i < n:
        c = text[i]
        if c == "`" or c == "}" and nest and nest[-1] == "$":
            m = _TEMPLATE_TEXT.match(text, i + 1)
            j = m.end()
            if c == "}":
                nest.pop()
            if m["end"] == "`":
                kind = "TEMPLATE" if c == "`" else "TTAIL"
            else:
                kind = "ERR" if m["end"] is None else "THEAD" if c == "`" else "TMIDDLE"
                nest.append("$")
        elif c == "/" and prev not in _ENDS - {"return", "}"} and (m := _REGEX.match(text, i)):
            kind, j = "REGEX", m.end()
        else:
            m = lex.match(text, i)
            j, group = m.end(), m.lastgroup
            if group == "ws":
                i = j
                continue
            t = m[0]
            if group == "nl" or group == "com":
                broke = broke or "\n" in t
                i = j
                continue
            if group == "word":
                kind = "IDENT" if prev in (".", "?.") else t if t in words or t in soft else "IDENT"
            elif group == "op":
                kind = t
                if t == "{":
                    nest.append(t)
                elif t == "}" and nest:
                    nest.pop()
            else:
                kind = {"num": "NUM", "str": "STR", "err": "ERR"}[group]
        if broke and (prev in _ENDS or prev == "void" and language == "typescript") and (kind not in _GOES_ON or kind in ("as", "from") and prev == "}"):
            out.append(("NL", i))
        broke = False
        out.append((kind, i))
        prev, i = kind, j
    if "$" in nest:  # a template without end
        out.append(("ERR", n))
    return out


#: Directives of the C preprocessor that make parts of a file conditional.
_CONDITIONS = {"if": OPEN, "ifdef": OPEN, "ifndef": OPEN, "elif": NEXT, "elifdef": NEXT, "elifndef": NEXT, "else": ELSE, "endif": CLOSE}
_DIRECTIVE = re.compile(r"[^\S\n]*([a-z]+)(?:[^\S\n]+(0)[^\S\n]*(?:$|/[/*]))?", re.M)


def _plain_tokens(text: str, language: str) -> Tokens:
    """Tokens of the other languages with braces; Go gets the semicolons that its line breaks stand for."""
    lex, words = _LEX["c" if language == "cpp" else language], _WORDS[language]
    go, rust, c = language == "go", language == "rust", language in ("c", "cpp")
    soft = {"java": {"record", "permits", "when", "yield"}, "rust": {"union", "raw", "box", "_"}}.get(language, set())
    out: Tokens = []
    prev, i, n = "", 0, len(text)
    while i < n:
        m = lex.match(text, i)
        group, t, at = m.lastgroup, m[0], i
        if group in ("h", "d"):
            group = "str"
        i = m.end()
        if c and t == "#" and group == "op" and not text[text.rfind("\n", 0, at) + 1 : at].strip():
            m = _DIRECTIVE.match(text, i)
            if m and m[1] in _CONDITIONS:
                out.append((OPEN_NEVER if m[1] == "if" and m[2] else _CONDITIONS[m[1]], at))
            while i < n:  # the rest of a directive, with its continued lines
                e = text.find("\n", i)
                i = n if e < 0 else e
                if e < 0 or text[e - 1] != "\\":
                    break
                i += 1
            continue
        if group == "nl" or go and group == "com" and "\n" in t:
            if go and (prev in ("IDENT", "NUM", "STR", ")", "]", "}", "++", "--", "break", "continue", "fallthrough", "return")):
                out.append((";", at))
                prev = ";"
            continue
        if group in ("ws", "com"):
            continue
        if group == "word":
            if c and t in ("__attribute__", "__declspec", "__extension__", "__restrict", "__inline", "_Noreturn", "_Alignas"):
                kind = "ATTR"
            elif c and t in ("asm", "__asm__"):
                kind = "ASM"
            elif language == "cpp" and t == "final" and prev == "IDENT":
                kind = "FINALWORD"
            elif language == "java" and (t == "sealed" or t == "non"):
                kind = "SEALEDWORD"
            else:
                kind = t if t in words or t in soft else "IDENT"
        elif group == "str":
            kind = "LIFETIME" if rust and t[0] == "'" and (len(t) < 3 or t[-1] != "'") else "STR"
        elif group == "num":
            kind = "NUM"
        else:
            kind = t if group == "op" else "ERR"
        out.append((kind, at))
        prev = kind
    if go and prev not in ("", ";", "{", "(", ","):
        out.append((";", n))
    return out


_PY_STR = r"(?:[rRbBuU]{0,2})(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')"
_PY_NUM = r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?"
_PY_OPS = "( ) [ ] { } , : := . ; @ = -> += -= *= /= //= %= @= &= |= ^= >>= <<= **= + - * / // % ** << >> & | ^ ~ < > <= >= == != ..."
_PY = re.compile(
    rf"(?P<ws>[ \t\f]+|\\\r?\n)|(?P<nl>\r?\n|\r)|(?P<com>\#[^\n]*)|(?P<fstr>(?:[fFtT][rR]?|[rR][fFtT])(?P<q>\"\"\"|'''|[\"']))|(?P<str>{_PY_STR})|(?P<num>{_PY_NUM})|(?P<word>[^\W\d]\w*)|(?P<op>"
    + "|".join(re.escape(o) for o in sorted(_PY_OPS.split(), key=len, reverse=True))
    + r")|(?P<err>[\s\S])"
)


@lru_cache(32)
def _f_text(quote: str, raw: bool, spec: bool) -> re.Pattern[str]:
    """What stands between the fields of an f-string, or in the format of a field."""
    plain = rf"[^{{}}\\{quote[0]}]|{quote[0]}(?!{quote[1:]})" if len(quote) > 1 else rf"[^{{}}\\\n{quote}]"
    escapes = ("" if raw else r"\\N\{[^}\n]*\}|") + r"\\[^{}]|\\(?=[{}])"
    return re.compile(rf"(?:{plain}|{escapes}{'' if spec else '|{{|}}'})*+".replace("|{{|}}", r"|\{\{|\}\}"))


def _python_tokens(text: str, language: str) -> Tokens:
    """Tokens of Python with line ends and indentation; the fields of an f-string are tokens like others, between FSTART and FEND."""
    words = _WORDS["python"]
    strings: list[tuple[str, bool, list[tuple[str, int]]]] = []  # open f-strings: quotes, raw, and the parts the place lies in
    out: Tokens = []
    text = text.removeprefix("\ufeff")
    depth, indents, i, n, fresh = 0, [0], 0, len(text), True
    while i < n:
        if fresh and not depth:
            j = i
            while j < n and text[j] in " \t\f":
                j += 1
            if j < n and text[j] not in "\r\n#":
                width = 0
                for ch in text[i:j]:
                    width = width + 1 if ch == " " else (width // 8 + 1) * 8 if ch == "\t" else 0
                if width > indents[-1]:
                    indents.append(width)
                    out.append(("INDENT", j))
                while width < indents[-1]:
                    indents.pop()
                    out.append(("DEDENT", j))
                    if width > indents[-1]:
                        out.append(("ERR", j))
                        return out
                fresh = False
            i = j
            if i >= n:
                break
        if strings and strings[-1][2][-1][0] != "code":
            quote, raw, parts = strings[-1]
            spec = parts[-1][0] == "format"
            i = _f_text(quote, raw, spec).match(text, i).end()
            if text.startswith("{", i):
                depth += 1
                parts.append(("code", depth))
                out.append(("FOPEN", i))
            elif text.startswith("}", i) and spec:
                del parts[-2:]
                depth -= 1
                out.append(("FCLOSE", i))
            elif text.startswith(quote, i) and not spec:
                strings.pop()
                out.append(("FEND", i))
                i += len(quote) - 1
            elif i < n:
                out.append(("ERR", i))
            i += 1
            continue
        m = _PY.match(text, i)
        group, t, at = m.lastgroup, m[0], i
        i = m.end()
        if strings and depth == strings[-1][2][-1][1] and t in ("}", ":", ":=", "!"):
            parts = strings[-1][2]
            if t == "}":
                parts.pop()
                depth -= 1
            elif t != "!":
                parts.append(("format", depth))
                i = at + 1
            out.append(({"}": "FCLOSE", "!": "!"}.get(t, "FSPEC"), at))
            continue
        if group == "fstr":
            strings.append((m["q"], "r" in t.lower(), [("text", 0)]))
            out.append(("FSTART", at))
            continue
        if group == "nl":
            if not depth:
                if not fresh:
                    out.append(("NEWLINE", at))
                fresh = True
            continue
        if group in ("ws", "com"):
            continue
        if group == "op":
            depth += (t in "([{") - (t in ")]}" and depth > 0)
            kind = t
        elif group == "word":
            kind = t if t in words or t in ("match", "case", "type") else "IDENT"
            if out and out[-1][0] == "NUM" and out[-1][1] < at and text[at - 1].isalnum() and kind not in ("and", "or", "in", "is", "if", "else", "not", "for"):
                kind = "ERR"
        else:
            kind = {"str": "STR", "num": "NUM", "err": "ERR"}[group]
        out.append((kind, at))
    if not fresh and not depth:
        out.append(("NEWLINE", n))
    if not depth:
        out += [("DEDENT", n)] * (len(indents) - 1)
    return out


def _json_tokens(text: str, language: str) -> Tokens:
    out: Tokens = []
    for m in _LEX["json"].finditer(text):
        if m.lastgroup != "ws":
            out.append(({"str": "STR", "num": "NUM", "err": "ERR"}.get(m.lastgroup, m[0]), m.start()))
    return out


_TOML_STR = r'"(?:[^"\\\x00-\x08\n-\x1f\x7f]|\\(?:["\\bfnrte]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{2}))*"|\'[^\'\x00-\x08\n-\x1f\x7f]*\''
_TOML_KEY = re.compile(rf"(?P<ws>[ \t]+)|(?P<nl>\r?\n)|(?P<com>\#[^\n]*)|(?P<str>{_TOML_STR})|(?P<bare>[A-Za-z0-9_-]+)|(?P<op>\[\[|\]\]|[\[\]{{}}=.,])|(?P<err>[\s\S])")
_TOML_VALUE = re.compile(
    rf"""(?P<ws>[ \t]+)|(?P<nl>\r?\n)|(?P<com>\#[^\n]*)|(?P<ml>\"\"\"(?:[^\\]|\\[\s\S])*?\"{{3,5}}|'''[\s\S]*?'{{3,5}})|(?P<str>{_TOML_STR})
    |(?P<scalar>(?:true|false|[+-]?(?:inf|nan)|\d{{4}}-\d\d-\d\d(?:[Tt\ ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d(?::\d\d(?:\.\d+)?)?|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*
      |[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?)(?![\w.+-]))|(?P<op>[\[\]{{}},=])|(?P<err>[\s\S])""",
    re.X,
)


def _toml_tokens(text: str, language: str) -> Tokens:
    """Keys and values have tokens of their own: what follows = and what stands in brackets of a value is a value."""
    out: Tokens = []
    nest: list[str] = []
    value, i, n = False, 0, len(text)
    while i < n:
        m = (_TOML_VALUE if value else _TOML_KEY).match(text, i)
        group, t, at = m.lastgroup, m[0], i
        i = m.end()
        if group in ("ws", "com"):
            continue
        if group == "nl":
            if nest and nest[-1] == "{":
                out.append(("ERR", at))
                return out
            out.append(("NEWLINE", at))
            value = bool(nest)
            continue
        kind = {"str": "STR", "ml": "MLSTR", "bare": "BARE", "scalar": "SCALAR", "err": "ERR"}.get(group, t)
        if t == "=" and group == "op":
            value = True
        elif value and group == "op":
            if t in "[{":
                nest.append(t)
                value = t == "["
            elif t in "]}":
                if nest:
                    nest.pop()
                value = True
            elif t == ",":
                value = bool(nest) and nest[-1] == "["
        elif not value and nest and group == "op" and t in "},":
            if t == "}":
                nest.pop()
                value = True
        out.append((kind, at))
    return out


_TOKENISERS: dict[str, Callable[[str, str], Tokens]] = {
    "javascript": _js_tokens, "typescript": _js_tokens, "python": _python_tokens, "json": _json_tokens, "toml": _toml_tokens,
    **{x: _plain_tokens for x in ("go", "java", "rust", "c", "cpp")},
}


def check(language: str, text: str) -> tuple[str, int]:
    """("ok", length), ("token", position of the token that fails) or ("end", length) for a text that stops too early."""
    if not text:
        return "ok", 0
    g = grammar(language)
    if language != "json":
        text = text.removeprefix("\ufeff")
    tokens = _TOKENISERS[language](text, language)
    kinds = g.tokens
    state, i = g.parse([k if isinstance(k, int) else kinds.get(k, 0) for k, _ in tokens] if language in ("c", "cpp") else [kinds.get(k, 0) for k, _ in tokens])
    return state, tokens[i][1] if state == "token" else len(text)
