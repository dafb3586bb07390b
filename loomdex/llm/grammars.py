"""Grammars of the supported languages, written for the recogniser of ``gll``; each is the union of the dialects named.

They describe what a parser accepts before names are looked up, and lean to acceptance where dialects differ.
"""

from __future__ import annotations

#: Expressions and statements that C, C++ and yacc actions share. Rules ``atom``, ``typename`` and ``local`` differ.
_C_COMMON = """
any = NOT['( ) [ ] { }'] | '(' any* ')' | '[' any* ']' | '{' any* '}' ;
balanced = '(' any* ')' ;
attr = '__attribute__' balanced | '__declspec' balanced | '[' '[' any* ']' ']' | 'alignas' balanced | '_Alignas' balanced ;
asm = ( 'asm' | '__asm__' ) ( 'volatile' | '__volatile__' | 'goto' )* balanced ;
expr = assign ( ',' assign )* ;
assign = unary ( binop unary | '?' expr? ':' unary )* ;
binop = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<' '<'? | '<' '<' '=' | '>' '>'? | '>' '>'? '=' | '<=' | '==' | '!=' | '&&' | '||' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | 'and' | 'or' ;
unary = ( '+' | '-' | '!' | '~' | '*' | '&' | '&&' | '++' | '--' | '__extension__' | 'not' )* ( postfix | cast | 'sizeof' unary | 'sizeof' '(' typename ')' | ( '_Alignof' | 'alignof' | '__alignof__' ) '(' typename ')' ) ;
cast = '(' typename ')' ( unary | braces ) ;
postfix = atom ( '[' expr ']' | '(' args? ')' | '.' member | '->' member | '++' | '--' )* ;
args = arg ( ',' arg )* ;
arg = assign | typename | braces ;
strings = ( STR | ID STR ) ( STR | ID )* ;
braces = '{' ( element ( ',' element )* ','? )? '}' ;
element = ( ( '[' expr ( '...' expr )? ']' | '.' ID )+ '='? | ID ':' )? init ;
init = assign | braces ;
block = '{' statement* '}' ;
statement = block | ';' | expr ';' | local | label | asm ';' | attr ';'
  | 'if' 'constexpr'? '(' condition ')' statement ( 'else' statement )?
  | 'while' '(' condition ')' statement | 'do' statement 'while' '(' expr ')' ';'
  | 'for' '(' ( expr? ';' | local ) condition? ';' expr? ')' statement
  | 'switch' '(' condition ')' statement
  | 'break' ';' | 'continue' ';' | 'return' ( expr | braces )? ';' | 'goto' ( ID | '*' expr ) ';'
  | special ;
label = ( ID | 'case' assign ( '...' assign )? | 'default' ) ':' ;
enum = 'enum' ( 'class' | 'struct' )? attr* name? ( ':' typename )? constants? ;
constants = '{' ( ID attr* ( '=' assign )? ( ',' ID attr* ( '=' assign )? )* ','? )? '}' ;
typeword = 'int' | 'char' | 'short' | 'long' | 'float' | 'double' | 'void' | 'signed' | 'unsigned' | '_Bool' | '_Complex' | 'bool' | 'wchar_t' | 'auto' | '__int128' ;
qualifier = 'const' | 'volatile' | 'restrict' | '__restrict' | '__const' | '_Atomic' | attr ;
storage = 'static' | 'extern' | 'typedef' | 'register' | 'inline' | '__inline' | '__inline__' | '_Noreturn' | '_Thread_local' | '__thread' | 'thread_local' | '__extension__' | 'mutable' | 'virtual' | 'explicit' | 'friend' | 'constexpr' | 'consteval' | 'constinit' ;
typeof = ( 'typeof' | '__typeof__' | 'decltype' ) balanced ;
mod = qualifier | storage ;
core = typeword ( typeword | mod )* | ( typeof | name | 'typename' name | struct | enum ) mod* ;
specs = mod+ ( name mod* )? core? | name mod* core? | core ;
pointer = ( '*' | '&' | '&&' ) qualifier* ;
typename = qualifier* ( typeword ( typeword | qualifier )* | ( typeof | struct | enum | name | 'typename' name ) qualifier* ) abstract? ;
abstract = pointer+ suffix* | pointer* '(' abstract ')' suffix* | suffix+ ;
suffix = '[' ( 'static' | qualifier )* expr? ']' | '(' params? ')' after* ;
params = param ( ',' param )* ( ',' '...' )? | '...' ;
declarator = pointer* ( declname | '(' qualifier* declarator ')' ) suffix* ( asm | attr )* ;
fdecl = pointer* ( declname | '(' qualifier* declarator ')' ) '(' params? ')' after* suffix* ( asm | attr )* ;
initdecl = declarator ( ':' assign )? ( '=' init )? ;
static_assert = ( '_Static_assert' | 'static_assert' ) balanced ';' ;
"""

C = (
    _C_COMMON
    + """
-- ISO C with GNU extensions, and old-style definitions
name = ID ;
member = ID ;
declname = ID ;
after = attr ;
atom = ID | NUM | CHR | strings | '(' expr ')' | '(' block ')' | '_Generic' balanced | 'this' ;
condition = expr ;
special = 'asm' ;
param = specs ( declarator | abstract )? | ID ;
struct = ( 'struct' | 'union' ) attr* ( ID | ID? fields attr* ) ;
fields = '{' field* '}' ;
units = '{' unit* '}' ;
field = specs ( fielddecl ( ',' fielddecl )* )? ';' | ';' | static_assert | ID '(' args? ')' ;
fielddecl = declarator ( ':' assign )? attr* | ':' assign ;
local = specs ( initdecl ( ',' initdecl )* )? ';' | static_assert | function ;
function = specs? fdecl ( specs declarator ( ',' declarator )* ';' )* block ;
unit = ';' | specs ( initdecl ( ',' initdecl )* )? ';' | function | asm ';' | static_assert
  | ID '(' args? ')' ';'? | 'extern' STR ( units | unit ) ;
"""
)

CPP = (
    _C_COMMON
    + """
-- C++ of all standards; what C alone allows is accepted too
targs = '<' ( targ ( ',' targ )* )? '>' ;
targ = ( typename | assign ) '...'? ;
simple = ( ID | 'final' | 'override' | 'concept' | 'requires' ) targs? ;
name = '::'? simple ( '::' 'template'? simple )* ;
opname = 'operator' ( binop | '(' ')' | '[' ']' | '!' | '~' | '++' | '--' | '->' | ',' | 'new' | 'delete' | typename | STR ID? ) ;
member = 'template'? name | '~' ID | opname ;
declname = '...'? name | ( name '::' )? ( '~' ID | opname ) | '...' ;
after = qualifier | 'noexcept' balanced? | 'override' | 'final' | '->' typename | 'throw' balanced | '&' | '&&' | attr ;
atom = name | typeword | NUM | CHR | strings | '(' expr ')' | '(' block ')' | '(' args '...' ')' | 'this' | 'nullptr' | 'true' | 'false' | lambda | opname | name '::' opname
  | ( name | typeword ) braces | 'typename' name | ( 'static_cast' | 'dynamic_cast' | 'const_cast' | 'reinterpret_cast' ) '<' typename '>' '(' expr ')'
  | ( 'typeid' | 'noexcept' ) balanced | '::'? 'new' ( '(' args ')' )? ( typename | '(' typename ')' ) ( '(' args? ')' | braces )? | '::'? 'delete' ( '[' ']' )? unary | 'throw' assign? | 'sizeof' '...' '(' ID ')' | 'co_await' unary ;
lambda = '[' any* ']' ( '(' params? ')' )? ( 'mutable' | 'constexpr' | after )* block ;
condition = expr | specs declarator ( '=' init | braces ) | ( local | expr ';' ) expr ;
special = 'try' block handler+ | 'throw' assign? ';' | 'for' '(' specs ( declarator | pointer* '[' ID ( ',' ID )* ']' ) ':' init ')' statement | ( 'co_return' | 'co_yield' ) expr? ';' | 'using' using ;
handler = 'catch' '(' ( '...' | param ) ')' block ;
param = specs '...'? ( declarator | abstract )? ( '=' init )? ;
struct = ( 'struct' | 'class' | 'union' ) attr* ( name | ( name 'final'? ( ':' base ( ',' base )* )? )? fields attr* ) ;
fields = '{' field* '}' ;
units = '{' unit* '}' ;
base = ( 'public' | 'private' | 'protected' | 'virtual' )* name '...'? ;
field = ( 'public' | 'private' | 'protected' ) ID? ':' | ID ':' | specs ( fielddecl ( ',' fielddecl )* )? ';' | ';' | function | static_assert | 'using' using | template field | ID '(' args? ')' ;
fielddecl = declarator ( ':' assign )? ( '=' ( init | 'default' | 'delete' ) | braces )? | ':' assign ;
local = specs ( localdecl ( ',' localdecl )* )? ';' | static_assert | specs pointer* '[' ID ( ',' ID )* ']' '=' init ';' ;
localdecl = initdecl | declarator ( '(' args? ')' | braces ) ;
function = specs? fdecl ( ':' meminit ( ',' meminit )* )? ( block | 'try' block handler+ | '=' ( 'default' | 'delete' | NUM ) ';' ) | specs? fdecl ';' ;
meminit = name ( '(' args? ')' | braces ) '...'? ;
template = 'template' ( '<' ( tparam ( ',' tparam )* )? '>' )? ( 'requires' assign )? ;
tparam = ( 'typename' | 'class' ) '...'? ID? ( '=' typename )? | param | template ( 'class' | 'typename' ) '...'? ID? ( '=' name )? | name ID? ;
using = 'namespace' name ';' | 'typename'? name ';' | ID attr* '=' typename ';' | 'enum' name ';' ;
namespace = 'inline'? 'namespace' attr* ( ID ( '::' ID )* )? units | 'namespace' ID '=' name ';' ;
concept = 'concept' ID '=' assign ';' ;
unit = ';' | specs ( localdecl ( ',' localdecl )* )? ';' | function | asm ';' | static_assert | namespace | 'using' using | template ( unit | concept )
  | ID '(' args? ')' ';'? | 'extern' STR ( units | unit ) | specs pointer* '[' ID ( ',' ID )* ']' '=' init ';' ;
"""
)

YACC = (
    C
    + """
-- yacc and bison; the text after the second mark is C
file = head* '%%' rules ( '%%' unit* )? ;
head = prologue | PCT thing* | ';' | ID ( ID | NUM | CHR | STR )* ;
prologue = '%{' unit* '%}' ;
thing = ID | CHR | STR | NUM | '<' any* '>' | '|' | '=' | '*' | GROUP ;
rules = ( rule | PCT thing* )* ;
rule = ID ( '[' ID ']' )? ':' alternative ( '|' alternative )* ';'? ;
alternative = ( ID ( '[' ID ']' )? | CHR | STR | action | PCT ( ID | CHR | STR | NUM | '<' any* '>' | action )? )* ;
action = block ;
"""
)

JAVA = """
-- Java of all editions; a unit may hold single statements only inside methods
any = NOT['( ) [ ] { }'] | '(' any* ')' | '[' any* ']' | '{' any* '}' ;
qualified = ID ( '.' ID )* ;
annotation = '@' qualified ( '(' ( pair ( ',' pair )* ','? )? ')' )? ;
pair = ID '=' value | value ;
value = expr | values | annotation ;
values = '{' ( value ( ',' value )* ','? )? '}' ;
modifier = annotation | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed' ;
primitive = 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double' | 'void' ;
type = annotation* ( primitive | classtype ) dims? ;
classtype = ID targs? ( '.' annotation* ID targs? )* ;
dims = ( annotation* '[' ']' )+ ;
targs = '<' ( targ ( ',' targ )* )? '>' ;
targ = annotation* ( type | '?' ( ( 'extends' | 'super' ) type )? ) ;
tparams = '<' tparam ( ',' tparam )* '>' ;
tparam = annotation* ID ( 'extends' type ( '&' type )* )? ;
types = type ( ',' type )* ;
unit = ';' | annotation* 'package' qualified ';' | 'import' 'static'? qualified ( '.' '*' )? ';' | typedecl | 'open'? 'module' qualified GROUP ;
typedecl = modifier* ( class | interface | enum | record | annotationtype ) ;
class = 'class' ID tparams? ( 'extends' type )? ( 'implements' types )? ( 'permits' types )? body ;
interface = 'interface' ID tparams? ( 'extends' types )? ( 'permits' types )? body ;
annotationtype = '@' 'interface' ID body ;
record = 'record' ID tparams? '(' params? ')' ( 'implements' types )? body ;
enum = 'enum' ID ( 'implements' types )? constants ;
constants = '{' ( constant ( ',' constant )* )? ','? ( ';' member* )? '}' ;
constant = annotation* ID ( '(' args? ')' )? body? ;
body = '{' member* '}' ;
member = ';' | typedecl | 'static'? block | modifier* tparams? method | modifier* type vars ';' ;
method = ( type? ID | ID ) ( '(' params? ')' )? dims? ( 'throws' types )? ( block | 'default' value ';' | ';' ) ;
params = param ( ',' param )* ;
param = modifier* type ( annotation* '...' )? ( ID '.' )* ( ID | 'this' ) dims? ;
vars = var ( ',' var )* ;
var = ID dims? ( '=' init )? ;
init = expr | inits ;
inits = '{' ( init ( ',' init )* ','? )? '}' ;
block = '{' statement* '}' ;
statement = block | ';' | expr ';' | modifier* type vars ';' | typedecl | ID ':' statement
  | 'if' '(' expr ')' statement ( 'else' statement )? | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';'
  | 'for' '(' ( ( modifier* type vars | exprs )? ';' expr? ';' exprs? | modifier* type ID ':' expr ) ')' statement
  | 'switch' '(' expr ')' switchbody | 'break' ID? ';' | 'continue' ID? ';' | 'return' expr? ';' | 'throw' expr ';' | 'yield' expr ';'
  | 'assert' expr ( ':' expr )? ';' | 'synchronized' '(' expr ')' block
  | 'try' ( '(' resource ( ';' resource )* ';'? ')' )? block ( 'catch' '(' modifier* type ( '|' type )* ID ')' block )* ( 'finally' block )? ;
resource = modifier* type ID '=' expr | expr ;
switchbody = '{' ( case | statement )* '}' ;
case = ( 'case' ( caselabel ( ',' caselabel )* ) | 'default' ) ( ':' | '->' ( expr ';' | block | 'throw' expr ';' ) ) ;
caselabel = ternary | type ID | 'default' ;
exprs = expr ( ',' expr )* ;
expr = ternary | lambda ;
ternary = unary ( binop ( unary | lambda ) | 'instanceof' modifier* type ID? | '?' expr ':' ( unary | lambda ) )* ;
lambda = ( ID | '(' ( ID ( ',' ID )* | params )? ')' ) '->' ( expr | block ) ;
binop = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<' '<'? | '<' '<' '=' | '<=' | '>' ( '>' '>'? )? | '>' ( '>' '>'? )? '=' | '==' | '!=' | '&&' | '||' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' ;
unary = ( '+' | '-' | '!' | '~' | '++' | '--' )* ( postfix | '(' type ( '&' type )* ')' ( unary | lambda ) ) ;
postfix = atom ( '.' targs? ( ID | 'class' | 'this' | 'super' | new ) | '[' expr ']' | '(' args? ')' | '++' | '--' | '::' ( ID | 'new' ) )* ;
atom = ID | NUM | STR | CHR | 'this' | 'super' | 'true' | 'false' | 'null' | '(' expr ')' | new | type '::' ( ID | 'new' ) | type '.' 'class' | 'switch' '(' expr ')' switchbody ;
new = 'new' annotation* ( classtype ( '(' args? ')' body? ) | type ( '[' expr ']' )* dims? inits? | ( primitive | classtype ) ( '[' expr ']' )+ dims? ) ;
args = expr ( ',' expr )* ;
"""

PYTHON = """
-- @3: Python 3; @2: Python 2. Names of the one that are reserved in the other are names in the one
unit = statement | NEWLINE ;
statement = simple ( ';' simple )* ';'? NEWLINE | compound ;
simple = targets | 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' ( expr ( @3 'from' expr | @2 ',' expr ( ',' expr )? )? )? | 'del' exprs | 'assert' expr ( ',' expr )?
  | 'import' asname ( ',' asname )* | 'from' ( '.' | '...' )* dotted? 'import' ( '*' | '(' asname ( ',' asname )* ','? ')' | asname ( ',' asname )* )
  | ( 'global' | @3 'nonlocal' ) ID ( ',' ID )* | @3 'type' ID typeparams? '=' expr | @2 print2 ;
print2 = 'print' ( exprs | '>' '>' exprs )? | 'exec' expr ( 'in' expr ( ',' expr )? )? ;
targets = exprs ( ( '=' ( exprs | yield ) )+ | @3 ':' expr ( '=' ( exprs | yield ) )? | augmented ( exprs | yield ) )? | yield ;
augmented = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '**=' | '<' '<' '=' | '>' '>' '=' | '<' '<=' | '>' '>=' ;
dotted = ID ( '.' ID )* ;
asname = dotted ( 'as' ID )? ;
compound = decorator* async? 'def' word typeparams? '(' params? ')' ( @3 '->' expr )? ':' suite
  | decorator* 'class' ID typeparams? ( '(' args? ')' )? ':' suite
  | 'if' test ':' suite ( 'elif' test ':' suite )* ( 'else' ':' suite )?
  | 'while' test ':' suite ( 'else' ':' suite )? | async? 'for' exprs 'in' exprs ':' suite ( 'else' ':' suite )?
  | async? 'with' ( withitem ( ',' withitem )* | '(' withitem ( ',' withitem )* ','? ')' ) ':' suite
  | 'try' ':' suite ( ( 'except' ( @3 '*' )? ( expr ( ( 'as' | @2 ',' ) expr )? )? ':' suite )+ ( 'else' ':' suite )? ( 'finally' ':' suite )? | 'finally' ':' suite )
  | @3 'match' exprs ':' NEWLINE cases ;
async = @3 'async' ;
cases = INDENT ( 'case' exprs ( 'as' ID )? ( 'if' test )? ':' suite )+ DEDENT ;
withitem = expr ( 'as' expr )? ;
decorator = '@' test NEWLINE ;
typeparams = @3 '[' any* ']' ;
any = NOT['( ) [ ] { } NEWLINE INDENT DEDENT'] | '(' any* ')' | '[' any* ']' | '{' any* '}' ;
suite = simple ( ';' simple )* ';'? NEWLINE | NEWLINE indented ;
indented = INDENT statement+ DEDENT ;
params = param ( ',' param )* ','? ;
param = ( '*' | '**' )? word ( @3 ':' expr )? ( '=' test )? | @3 ( '*' | '/' ) | @2 '(' params ')' ( '=' test )? ;
word = ID | 'print' | 'exec' | 'match' | 'case' | 'type' | @2 ( 'async' | 'await' | 'nonlocal' ) ;
exprs = expr ( ',' expr )* ','? ;
expr = test | @3 ( '*' | '**' ) test ;
test = or ( 'if' or 'else' test )? | 'lambda' params? ':' test | @3 ID ':=' test | 'not' test ;
or = operand ( binop operand )* ;
operand = ( '+' | '-' | '~' | 'not' | @3 'await' )* postfix ;
binop = '+' | '-' | '*' | '/' | '//' | '%' | @3 '@' | '**' | '&' | '|' | '^' | '<' '<'? | '>' '>'? | @2 '<' '>' | '<=' | '>=' | '==' | '!=' | 'and' | 'or' | 'in' | 'not' 'in' | 'is' 'not'? ;
postfix = atom ( '.' word | '(' args? ')' | '[' slices ']' )* ;
slices = slice ( ',' slice )* ','? ;
slice = expr? ( ':' expr? )* ;
atom = word | NUM | @2 OLDNUM | @3 NEWNUM | string+ | 'True' | 'False' | 'None' | '...' | '(' ( yield | exprs comp? )? ')' | '[' ( exprs comp? )? ']' | '{' ( entries comp? )? '}' | @2 '`' exprs '`' ;
string = STR | @2 OLDSTR | @3 FHEAD ( '(' ( yield | exprs ) ')' )* FTAIL ;
entries = entry ( ',' entry )* ','? ;
entry = expr ( ':' test )? ;
comp = ( async? 'for' exprs 'in' or ( 'if' test )* ( ',' or )* | async? 'for' exprs 'in' 'lambda' params? ':' test )+ ;
args = arg ( ',' arg )* ','? ;
arg = word '=' test | test comp? | ( '*' | '**' ) test ;
yield = 'yield' ( @3 'from' test | exprs )? ;
"""

JAVASCRIPT = """
-- ECMAScript of all editions, @module a module, @script a script; NL is a line end where a statement may end without a semicolon
unit = statement ;
any = NOT['( ) [ ] { }'] | '(' any* ')' | '[' any* ']' | '{' any* '}' ;
statement = block | ';' | exprs end | declaration end | function | class | word ':' statement
  | 'if' '(' exprs ')' statement ( 'else' statement )? | 'while' '(' exprs ')' statement | 'do' statement 'while' '(' exprs ')' end
  | 'for' 'await'? '(' ( ( declaration | exprs )? ';' exprs? ';' exprs? | ( ( 'var' | 'let' | 'const' )? target | postfix ) ( 'of' | 'in' ) exprs ) ')' statement
  | 'switch' '(' exprs ')' switchbody
  | 'break' ( ID )? end | 'continue' ( ID )? end | 'return' exprs? end | 'throw' exprs end | 'debugger' end | @script 'with' '(' exprs ')' statement
  | 'try' block ( 'catch' ( '(' target ')' )? block )? ( 'finally' block )?
  | @module 'import' any end | @module 'import' ( word | '*' 'as' word | GROUP | ',' )+ 'from' STR end | @module 'import' STR end
  | @module 'export' ( declaration end | function | class | 'default' ( expr end | function | class ) | '*' ( 'as' word )? 'from' STR end | GROUP ( 'from' STR )? end ) ;
end = ';' | NL ;
block = '{' statement* '}' ;
switchbody = '{' ( ( 'case' exprs | 'default' ) ':' | statement )* '}' ;
declaration = ( 'var' | 'let' | 'const' ) binding ( ',' binding )* ;
binding = target ( '=' expr )? ;
target = word | '[' ( ( '...'? target ( '=' expr )? )? ','? )* ']' | object ;
word = ID | 'let' | 'of' | 'async' | 'await' | 'get' | 'set' | 'static' | 'as' | 'from' | 'yield' ;
anyword = word | 'var' | 'const' | 'if' | 'else' | 'for' | 'while' | 'do' | 'switch' | 'case' | 'default' | 'break' | 'continue' | 'return' | 'throw' | 'try' | 'catch' | 'finally' | 'function' | 'class' | 'new' | 'delete' | 'typeof' | 'void' | 'in' | 'instanceof' | 'this' | 'null' | 'true' | 'false' | 'import' | 'export' | 'extends' | 'super' | 'debugger' | 'with' ;
function = 'async'? 'function' '*'? word? '(' params? ')' block ;
params = param ( ',' param )* ','? ;
param = '...'? target ( '=' expr )? ;
class = 'class' word? ( 'extends' postfix )? classbody ;
classbody = '{' ( ';' | 'static' block | 'static'? ( 'async'? '*'? | 'get' | 'set' ) key '(' params? ')' block | 'static'? key ( '=' expr )? end )* '}' ;
key = anyword | STR | NUM | '#' ID | '[' expr ']' ;
exprs = expr ( ',' expr )* ;
expr = ternary | arrow | 'yield' '*'? expr? ;
arrow = 'async'? ( word | '(' params? ')' ) '=>' ( expr | block ) ;
ternary = unary ( binop ( unary | arrow ) | '?' expr ':' ( unary | arrow ) )* ;
binop = '+' | '-' | '*' | '/' | '%' | '**' | '&' | '|' | '^' | '<' '<'? | '<' '<=' | '>' ( '>' '>'? )? | '>' '>=' | '>' '>' '>=' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '&&' | '||' | '??' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' | 'in' | 'instanceof' ;
unary = ( '+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' )* postfix ;
postfix = atom ( '.' '#'? anyword | '?.' ( anyword | '[' exprs ']' | '(' args? ')' ) | '[' exprs ']' | '(' args? ')' | template | '++' | '--' )* ;
template = TEMPLATE | HEAD exprs ( MIDDLE exprs )* TAIL ;
atom = word | NUM | STR | REGEX | template | 'this' | 'null' | 'true' | 'false' | 'super' | '(' exprs ')' | function | class | object | array | 'new' ( '.' ID | unary ) | 'import' ( balanced | '.' ID ) ;
balanced = '(' any* ')' ;
args = '...'? expr ( ',' '...'? expr )* ','? ;
array = '[' ( ( '...'? expr )? ( ',' ( '...'? expr )? )* )? ']' ;
object = '{' ( property ( ',' property )* ','? )? '}' ;
property = key ( ':' expr )? ( '=' expr )? | '...' expr | ( 'async'? '*'? | 'get' | 'set' ) key '(' params? ')' block ;
"""

PHP = """
-- @old: PHP 4 to 7; @new: PHP 8; HTML stands between the blocks and ends a statement
unit = statement ;
any = NOT['( ) [ ] { }'] | '(' any* ')' | '[' any* ']' | '{' any* '}' ;
name = '\\'? ID ( '\\' ID )* | 'namespace' '\\' ID ( '\\' ID )* ;
attribute = @new '#[' any* ']' ;
statement = HTML | ';' | block | expr end | ID ':' | ( 'echo' | 'print' ) exprs end
  | 'if' '(' expr ')' ( statement ( 'elseif' '(' expr ')' statement | 'else' 'if' '(' expr ')' statement )* ( 'else' statement )? | ':' statement* ( 'elseif' '(' expr ')' ':' statement* )* ( 'else' ':' statement* )? 'endif' end )
  | 'while' '(' expr ')' ( statement | ':' statement* 'endwhile' end ) | 'do' statement 'while' '(' expr ')' end
  | 'for' '(' exprs? ';' exprs? ';' exprs? ')' ( statement | ':' statement* 'endfor' end )
  | 'foreach' '(' expr 'as' ( expr '=>' )? '&'? expr ')' ( statement | ':' statement* 'endforeach' end )
  | 'switch' '(' expr ')' ( switchbody | ':' cases 'endswitch' end )
  | 'break' expr? end | 'continue' expr? end | 'return' expr? end | 'throw' expr end | 'goto' ID end
  | 'global' exprs end | 'static' VAR ( '=' expr )? ( ',' VAR ( '=' expr )? )* end | 'unset' '(' exprs ','? ')' end | 'declare' '(' any* ')' ( end | block )
  | 'try' block ( 'catch' '(' name ( '|' name )* VAR? ')' block )* ( 'finally' block )?
  | 'namespace' name? ( end | block ) | 'use' any any* end | 'const' anyword '=' expr ( ',' anyword '=' expr )* end
  | function | class | '__halt_compiler' any* ;
end = ';' | HTML ;
cases = ( ( 'case' expr | 'default' ) ( ':' | ';' ) | statement )* ;
block = '{' statement* '}' ;
switchbody = '{' cases '}' ;
index = '{' expr '}' ;
function = attribute* 'function' '&'? anyword '(' params? ')' ( ':' type )? block ;
params = param ( ',' param )* ','? ;
param = attribute* modifier* type? '&'? '...'? VAR ( '=' expr )? ;
type = '?'? ( name | 'array' | 'static' | 'callable' | 'null' | 'false' | '(' type ')' ) ( ( '|' | '&' ) ( name | 'array' | 'null' | 'false' | 'static' | '(' type ')' ) )* ;
modifier = 'public' | 'private' | 'protected' | 'static' | 'abstract' | 'final' | 'var' | 'readonly' ;
class = attribute* ( 'abstract' | 'final' | 'readonly' )* ( 'class' | 'interface' | 'trait' | @new 'enum' ) ID ( ':' type )? ( 'extends' names )? ( 'implements' names )? body ;
names = name ( ',' name )* ;
body = '{' member* '}' ;
member = attribute* modifier* ( 'function' '&'? anyword '(' params? ')' ( ':' type )? ( block | ';' ) | 'const' type? anyword '=' expr ( ',' anyword '=' expr )* ';' | type? VAR ( '=' expr )? ( ',' VAR ( '=' expr )? )* ';' ) | 'use' names ( ';' | GROUP ) | 'case' anyword ( '=' expr )? ';' ;
anyword = ID | 'list' | 'print' | 'echo' | 'use' | 'default' | 'class' | 'function' | 'array' | 'static' | 'new' | 'clone' | 'isset' | 'empty' | 'unset' | 'include' | 'require' | 'for' | 'foreach' | 'if' | 'else' | 'return' | 'switch' | 'case' | 'and' | 'or' | 'global' | 'throw' | 'try' | 'catch' | 'do' | 'while' | 'break' | 'continue' | 'exit' | 'match' | 'fn' | 'null' | 'true' | 'false' | 'public' | 'private' | 'protected' | 'const' | 'enum' | 'readonly' | 'as' | 'namespace' ;
exprs = expr ( ',' expr )* ;
expr = unary ( binop unary | 'instanceof' unary | '?' expr? ':' unary )* ;
binop = '+' | '-' | '*' | '/' | '%' | '**' | '.' | '&' | '|' | '^' | '<' '<'? | '>' '>'? | '<' '>' | '<=' '>'? | '>=' | '==' | '!=' | '===' | '!==' | '&&' | '||' | '??' | 'and' | 'or' | 'xor' | '=' '&'? | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '.=' | '&=' | '|=' | '^=' | '??=' | '<' '<=' | '>' '>=' ;
unary = ( '+' | '-' | '!' | '~' | '@' | '&' | '++' | '--' | 'clone' | 'print' | 'throw' | 'include' | 'include_once' | 'require' | 'require_once' | 'yield' | '(' cast ')' )* ( postfix | 'yield' 'from'? ( expr ( '=>' expr )? )? ) ;
cast = 'int' | 'integer' | 'string' | 'bool' | 'boolean' | 'float' | 'double' | 'array' | 'object' | 'binary' | 'unset' ;
postfix = atom ( '[' expr? ']' | @old index | ( '->' | @new '?->' ) ( anyword | VAR | index | '$' VAR ) | '::' ( anyword | VAR | index ) | '(' args? ')' | '++' | '--' )* ;
atom = VAR | '$'+ ( VAR | index ) | NUM | STR | name | 'int' | 'string' | 'float' | 'bool' | 'object' | 'double' | 'integer' | 'boolean' | 'binary' | 'static' | 'null' | 'true' | 'false' | '(' expr ')' | 'array' '(' items? ')' | 'list' '(' items? ')' | '[' items? ']' | ( 'isset' | 'empty' ) '(' exprs ','? ')' | 'exit' ( '(' expr? ')' )?
  | 'static'? 'function' '&'? '(' params? ')' ( 'use' '(' ( '&'? VAR ( ',' '&'? VAR )* ','? )? ')' )? ( ':' type )? block | 'static'? 'fn' '&'? '(' params? ')' ( ':' type )? '=>' expr
  | 'new' ( name | VAR | 'static' | '(' expr ')' ) ( ( '->' | '::' ) ( ID | VAR ) )* ( '(' args? ')' )? | 'new' attribute* 'class' ( '(' args? ')' )? ( 'extends' name )? ( 'implements' names )? body
  | @new 'match' '(' expr ')' matchbody | @old 'match' ;
matchbody = '{' ( matcharm ( ',' matcharm )* ','? )? '}' ;
matcharm = ( 'default' | exprs ','? ) '=>' expr ;
items = item? ( ',' item? )* ;
item = '...'? '&'? expr ( '=>' '&'? expr )? ;
args = arg ( ',' arg )* ','? ;
arg = @new '...' | '...'? expr | @new anyword ':' expr ;
"""

ASM = """
-- assembler sources: AT&T and Intel operands, GNU and old directives; one statement a line
unit = label* ( directive | ID | ID operands | ID '=' '='? operand | ID ID operands? )? NEWLINE | label* ID ID NEWLINE ;
label = ( ID | NUM | STR | DOT ) ':' ':'? ;
directive = DOT ( operands | ( operand | '@' ID | '#' )+ ( ',' ( operand | '@' ID | '%' ID )+ )* )? ;
operands = operand? ( ',' operand? )* ;
operand = prefix* ( sum ( '(' memory? ')' )* postfix? | '(' memory ')' postfix? | '{' operands '}' | '[' any* ']' '!'? ) ;
prefix = '$' | '*' | '%' | '#' | '@' | '=' | '!' ;
postfix = '@' ID | '!' | '{' operands '}' | ':' operand ;
memory = operand? ( ',' operand? )* ;
any = NOT['( ) [ ] { } NEWLINE'] | '(' any* ')' | '[' any* ']' ;
sum = term ( op term )* ;
op = '+' | '-' | '*' | '/' | '|' | '&' | '^' | '<' '<' | '>' '>' | '%' | '==' | '<' | '>' | '!=' | '&&' | '||' | '.' | ':' ;
term = ( '-' | '+' | '~' | '!' | '%' | '$' )* ( ID | NUM | STR | CHR | DOT | '(' sum ')' | ID '@' ID | ID ID ) ;
"""

#: Language: the text of its grammar, the rule of its items, the rules of its groups, what brackets them, its dialects.
GRAMMARS = {
    "c": (C, "unit", ("block", "braces", "constants", "fields", "units"), ("{", "}"), ("",)),
    "cpp": (CPP, "unit", ("block", "braces", "constants", "fields", "units"), ("{", "}"), ("",)),
    "java": (JAVA, "unit", ("block", "body", "constants", "inits", "switchbody", "values"), ("{", "}"), ("",)),
    "python": (PYTHON, "unit", ("indented", "cases"), ("INDENT", "DEDENT"), ("3", "2")),
    "javascript": (JAVASCRIPT, "unit", ("block", "object", "classbody", "switchbody"), ("{", "}"), ("script", "module")),
    "php": (PHP, "unit", ("block", "body", "switchbody", "matchbody", "index"), ("{", "}"), ("old", "new")),
    "asm": (ASM, "unit", (), ("", ""), ("",)),
    "yacc": (YACC, "file", ("block", "braces", "constants", "fields"), ("{", "}"), ("",)),
}
