"""Grammars of Python, JavaScript, Java and Go for the recogniser.

Operators are not ranked, as ranks don't bear on what is valid. Each language's dialects share its rules: Python with
and without async as a plain name, JavaScript modules and scripts, Java units and module declarations, Go.
"""

from millrace.llm.gll import Grammar
from millrace.plans.shared import once

_PYTHON = {
    "file": "( NEWLINE | stmt )*",
    "file_36": "( NEWLINE | stmt | plain_async )*",
    "plain_async": "( 'async' | 'await' ) '=' exprs NEWLINE",
    "stmt": "simple | 'if' named ':' block ( 'elif' named ':' block )* ( 'else' ':' block )? | while | for | try | with | func | class | decorated | 'async' ( func | with | for ) | match",
    "simple": "small ( ';' small )* ';'? NEWLINE",
    "block": "simple | NEWLINE INDENT stmt+ DEDENT",
    "small": "assign | exprs | 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' ( expr ( 'from' expr )? )? | ( 'global' | 'nonlocal' ) NAME ( ',' NAME )* | 'del' targets | 'assert' expr ( ',' expr )? | import | 'type' NAME tparams? '=' expr",
    "assign": "( targets '=' )+ ( exprs | yield ) | single ':' expr ( '=' ( exprs | yield ) )? | single aug ( exprs | yield )",
    "aug": "'+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='",
    "targets": "target ( ',' target )* ','?",
    "target": "'*'? single",
    "single": "NAME | '(' targets? ')' | '[' targets? ']' | atom trailer* ( '.' NAME | '[' subs ']' )",
    "exprs": "star ( ',' star )* ','? | yield",
    "star": "'*' expr | named",
    "yield": "'yield' ( 'from' expr | exprs )?",
    "named": "( NAME ':=' )? expr",
    "expr": "'lambda' lparams? ':' expr | test ( 'if' test 'else' expr )?",
    "test": "unary ( binary unary )*",
    "binary": "'+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '<<' | '>>' | '&' | '|' | '^' | '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' 'not'? | 'and' | 'or'",
    "unary": "( 'not' | '-' | '+' | '~' | 'await' )* atom trailer*",
    "atom": "NAME | NUM | STR+ | BYTES+ | '...' | 'None' | 'True' | 'False' | '(' ( yield | star comp? | star ( ',' star )* ','? )? ')' | '[' ( star comp? | star ( ',' star )* ','? )? ']' | '{' ( pair comp? | pair ( ',' pair )* ','? | star comp? | star ( ',' star )* ','? )? '}'",
    "pair": "expr ':' expr | '**' expr",
    "comp": "( 'async'? 'for' targets 'in' test ( 'if' ctest )* )+",
    "ctest": "( NAME ':=' )? ( test | 'lambda' lparams? ':' ctest )",
    "trailer": "'.' NAME | '(' args? ')' | '[' subs ']'",
    "args": "arg ( ',' arg )* ','?",
    "arg": "NAME '=' expr | '*' expr | '**' expr | named comp?",
    "subs": "sub ( ',' sub )* ','?",
    "sub": "star | expr? ':' expr? ( ':' expr? )?",
    "import": "'import' dotted ( 'as' NAME )? ( ',' dotted ( 'as' NAME )? )* | 'from' ( '.' | '...' )* dotted? 'import' ( '*' | aliases | '(' aliases ','? ')' )",
    "aliases": "NAME ( 'as' NAME )? ( ',' NAME ( 'as' NAME )? )*",
    "dotted": "NAME ( '.' NAME )*",
    "while": "'while' named ':' block ( 'else' ':' block )?",
    "for": "'for' targets 'in' exprs ':' block ( 'else' ':' block )?",
    "try": "'try' ':' block ( ( 'except' '*'? ( expr ( 'as' NAME | ( ',' expr )+ )? )? ':' block )+ ( 'else' ':' block )? ( 'finally' ':' block )? | 'finally' ':' block )",
    "with": "'with' ( items | '(' items ','? ')' ) ':' block",
    "items": "expr ( 'as' target )? ( ',' expr ( 'as' target )? )*",
    "func": "'def' NAME tparams? '(' params? ')' ( '->' expr )? ':' block",
    "params": "param ( ',' param )* ','?",
    "param": "NAME ( ':' expr )? ( '=' expr )? | '*' ( NAME ( ':' ( expr | '*' expr ) )? )? | '**' NAME ( ':' expr )? | '/'",
    "lparams": "lparam ( ',' lparam )* ','?",
    "lparam": "NAME ( '=' expr )? | '*' NAME? | '**' NAME | '/'",
    "tparams": "'[' tparam ( ',' tparam )* ','? ']'",
    "tparam": "( '*' | '**' )? NAME ( ':' expr )? ( '=' expr )?",
    "class": "'class' NAME tparams? ( '(' args? ')' )? ':' block",
    "decorated": "( '@' named NEWLINE )+ ( func | class | 'async' func )",
    "match": "'match' exprs ':' NEWLINE INDENT ( 'case' patterns ( 'if' named )? ':' block )+ DEDENT",
    "patterns": "pattern ( ',' pattern )* ','?",
    "pattern": "'*' NAME | closed ( '|' closed )* ( 'as' NAME )?",
    "closed": "'-'? NUM ( ( '+' | '-' ) NUM )? | STR+ | BYTES+ | 'None' | 'True' | 'False' | dotted ( '(' ( cpat ( ',' cpat )* ','? )? ')' )? | '(' patterns? ')' | '[' patterns? ']' | '{' ( mpat ( ',' mpat )* ','? )? '}'",
    "cpat": "( NAME '=' )? pattern",
    "mpat": "( '-'? NUM | STR+ | BYTES+ | 'None' | 'True' | 'False' | dotted ) ':' pattern | '**' NAME",
}

_JAVASCRIPT = {
    "module": "( import EOS | export | stmt )*",
    "script": "stmt*",
    "import": "'import' ( STR | clause 'from' STR ) ( 'with' object )?",
    "clause": "NAME ( ',' ( star_as | names ) )? | star_as | names",
    "star_as": "'*' 'as' NAME",
    "names": "'{' ( name ( ',' name )* ','? )? '}'",
    "name": "( word | STR ) ( 'as' ( word | STR ) )?",
    "export": "'export' ( 'default' ( function | class | assign EOS ) | declaration | ( '*' ( 'as' ( word | STR ) )? 'from' STR | names ( 'from' STR )? ) ( 'with' object )? EOS )",
    "declaration": "( 'var' | 'let' | 'const' ) bindings EOS | function | class",
    "bindings": "bound ( ',' bound )*",
    "bound": "binding ( '=' assign )?",
    "binding": "NAME | '[' ( ',' | slot )* ']' | '{' ( bprop ( ',' bprop )* ','? )? '}'",
    "slot": "'...'? binding ( '=' assign )?",
    "bprop": "'...' NAME | NAME ( '=' assign )? | key ':' binding ( '=' assign )?",
    "block": "'{' stmt* '}'",
    "stmt": "block | declaration | ';' | 'if' '(' expr ')' stmt ( 'else' stmt )? | 'for' 'await'? '(' forhead ')' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'? | 'return' expr? EOS | ( 'break' | 'continue' ) NAME? EOS | 'throw' expr EOS | 'try' block ( 'catch' ( '(' binding ')' )? block ( 'finally' block )? | 'finally' block ) | switch | expr EOS | NAME ':' stmt | 'debugger' EOS | 'with' '(' expr ')' stmt",
    "forhead": "( ( 'var' | 'let' | 'const' ) bindings | expr )? ';' expr? ';' expr? | ( 'var' | 'let' | 'const' )? ( binding | postfix ) ( 'of' assign | 'in' expr )",
    "switch": "'switch' '(' expr ')' '{' ( ( 'case' expr | 'default' ) ':' stmt* )* '}'",
    "expr": "assign ( ',' assign )*",
    "assign": "operand ( binary operand )* ( '?' assign ':' assign )?",
    "binary": "'+' | '-' | '*' | '/' | '%' | '**' | '<<' | '>>' | '>>>' | '&' | '|' | '^' | '&&' | '||' | '??' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | 'in' | 'instanceof' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='",
    "operand": "arrow | 'yield' '*'? assign? | prefix* postfix ( '++' | '--' )?",
    "prefix": "'!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await'",
    "arrow": "'async'? ( NAME | params ) '=>' ( block | assign )",
    "params": "'(' ( param ( ',' param )* ','? )? ')'",
    "param": "'...'? binding ( '=' assign )?",
    "postfix": "primary trailer*",
    "trailer": "'.' word | '?.' ( word | '[' expr ']' | args ) trailer* | '[' expr ']' | args | template",
    "args": "'(' ( arg ( ',' arg )* ','? )? ')'",
    "arg": "'...'? assign",
    "primary": "NAME | NUM | STR | REGEX | template | 'this' | 'super' | 'null' | 'true' | 'false' | '(' expr ')' | '[' ( ',' | arg )* ']' | object | function | class | 'new' ( '.' word | primary ) | 'import' ( '.' word | args )",
    "template": "TEMPLATE | HEAD expr ( MIDDLE expr )* TAIL",
    "object": "'{' ( prop ( ',' prop )* ','? )? '}'",
    "prop": "'...' assign | NAME '=' assign | NAME | key ':' assign | modifier* key params block",
    "modifier": "'get' | 'set' | 'async' | '*' | 'static'",
    "key": "word | STR | NUM | '[' assign ']'",
    "word": "NAME | 'await' | 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'export' | 'extends' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with' | 'null' | 'true' | 'false' | 'enum'",
    "function": "'async'? 'function' '*'? NAME? params block",
    "class": "'class' NAME? ( 'extends' postfix )? '{' ( ';' | member )* '}'",
    "member": "modifier* key params block | 'static'? key ( '=' assign )? EOS | 'static' block",
}

_JAVA = {
    "unit": "( annotation* 'package' dotted ';' )? ( 'import' 'static'? dotted ( '.' '*' )? ';' | ';' )* ( type_declaration | ';' )*",
    "module_unit": "( 'import' dotted ( '.' '*' )? ';' )* annotation* 'open'? 'module' dotted '{' directive* '}'",
    "directive": "( 'requires' ( 'transitive' | 'static' )* dotted | ( 'exports' | 'opens' ) dotted ( 'to' dotted ( ',' dotted )* )? | 'uses' dotted | 'provides' dotted 'with' dotted ( ',' dotted )* ) ';'",
    "dotted": "NAME ( '.' NAME )*",
    "annotation": "'@' dotted ( '(' ( avalue | NAME '=' avalue ( ',' NAME '=' avalue )* )? ')' )?",
    "avalue": "ternary | annotation | '{' ( avalue ( ',' avalue )* )? ','? '}'",
    "modifier": "annotation | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed'",
    "type_declaration": "modifier* ( class | enum | interface | record | 'at_interface' )",
    "class": "'class' NAME tparams? ( 'extends' type )? ( 'implements' types )? ( 'permits' types )? body",
    "interface": "'@'? 'interface' NAME tparams? ( 'extends' types )? ( 'permits' types )? body",
    "record": "'record' NAME tparams? '(' params? ')' ( 'implements' types )? body",
    "enum": "'enum' NAME ( 'implements' types )? '{' ( constant ( ',' constant )* )? ','? ( ';' member* )? '}'",
    "constant": "annotation* NAME args? body?",
    "body": "'{' member* '}'",
    "member": "';' | 'static'? block | modifier* ( class | enum | interface | record | tparams? ( ( type | 'void' ) NAME '(' params? ')' dims? throws? ( block | ( 'default' avalue )? ';' ) | NAME '(' params? ')' throws? block | NAME block ) | type declarators ';' )",
    "throws": "'throws' types",
    "params": "param ( ',' param )*",
    "param": "modifier* type annotation* '...'? ( NAME dims? | ( NAME '.' )* 'this' )",
    "tparams": "'<' tparam ( ',' tparam )* '>'",
    "tparam": "annotation* NAME ( 'extends' type ( '&' type )* )?",
    "types": "type ( ',' type )*",
    "type": "annotation* ( basic | named_type ) dims?",
    "basic": "'boolean' | 'byte' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double'",
    "named_type": "NAME targs? ( '.' annotation* NAME targs? )*",
    "targs": "'<' ( targ ( ',' targ )* )? '>'",
    "targ": "type | annotation* '?' ( ( 'extends' | 'super' ) type )?",
    "dims": "( annotation* '[' ']' )+",
    "declarators": "declarator ( ',' declarator )*",
    "declarator": "NAME dims? ( '=' init )?",
    "init": "expr | '{' ( init ( ',' init )* )? ','? '}'",
    "block": "'{' statement* '}'",
    "statement": "block | ';' | modifier* ( type | 'var' ) declarators ';' | modifier* ( class | record | enum | interface ) | 'if' '(' expr ')' statement ( 'else' statement )? | 'for' '(' ( forinit? ';' expr? ';' exprs? | modifier* ( type | 'var' ) NAME dims? ':' expr ) ')' statement | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';' | 'return' expr? ';' | ( 'break' | 'continue' ) NAME? ';' | 'throw' expr ';' | 'yield' expr ';' | 'assert' expr ( ':' expr )? ';' | 'synchronized' '(' expr ')' block | try | switch | effect ';' | NAME ':' statement",
    "forinit": "modifier* ( type | 'var' ) declarators | exprs",
    "exprs": "expr ( ',' expr )*",
    "try": "'try' ( '(' resource ( ';' resource )* ';'? ')' )? block ( 'catch' '(' modifier* type ( '|' type )* NAME ')' block )* ( 'finally' block )?",
    "resource": "modifier* ( type | 'var' ) NAME '=' expr | postfix",
    "switch": "'switch' '(' expr ')' '{' ( group* | arm+ ) '}'",
    "group": "label ':' statement*",
    "arm": "label '->' ( expr ';' | block | 'throw' expr ';' )",
    "label": "'case' ( clabel ( ',' clabel )* ) ( 'when' expr )? | 'default'",
    "clabel": "ternary | 'default' | pattern",
    "pattern": "modifier* type ( NAME | '(' ( pattern ( ',' pattern )* )? ')' NAME? )",
    # An expression that is a statement: assignments, calls, increments and creations.
    "effect": "postfix assignment expr | ( '++' | '--' ) postfix | postfix ( '++' | '--' ) | call",
    "call": "primary trailer* ( args | '.' targs? ( NAME | 'super' | 'this' ) args ) | NAME args | ( 'this' | 'super' ) args | creation",
    "expr": "lambda | ternary ( assignment expr )?",
    "assignment": "'=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>='",
    "lambda": "( NAME | '(' ( NAME ( ',' NAME )* | params )? ')' ) '->' ( expr | block )",
    "ternary": "binary ( '?' expr ':' ( ternary | lambda ) )?",
    "binary": "unary ( operator unary | 'instanceof' ( modifier* type | pattern ) )*",
    "operator": "'+' | '-' | '*' | '/' | '%' | '<<' | '>' '>' '>'? | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&' | '|' | '^' | '&&' | '||'",
    "unary": "( '+' | '-' | '++' | '--' | '!' | '~' ) unary | cast | postfix ( '++' | '--' )*",
    "cast": "'(' type ( '&' type )* ')' ( unary | lambda )",
    "postfix": "primary trailer*",
    "primary": "NAME args? | NUM | STR | 'true' | 'false' | 'null' | ( 'this' | 'super' ) args? | '(' expr ')' | creation | ( basic | 'void' | named_type ) dims? '.' 'class' | ( named_type dims? | basic dims ) '::' targs? ( NAME | 'new' ) | switch",
    "creation": "'new' targs? annotation* ( basic | named_type ) ( args body? | ( annotation* '[' expr ']' )+ dims? | dims '{' ( init ( ',' init )* )? ','? '}' )",
    "trailer": "'.' targs? ( NAME args? | 'super' args? | 'this' | 'new' targs? annotation* NAME targs? args body? ) | '[' expr ']' | '::' targs? ( NAME | 'new' )",
    "args": "'(' exprs? ')'",
}
_JAVA["type_declaration"] = _JAVA["type_declaration"].replace(" | 'at_interface'", "")

_GO = {
    "file": "'package' NAME ';' ( import ';' )* ( declaration ';' )*",
    "import": "'import' ( spec | '(' ( spec ( ';' spec )* ';'? )? ')' )",
    "spec": "( NAME | '.' )? STR",
    "declaration": "func | const | var | typedef",
    "const": "'const' ( cspec | '(' ( cspec ( ';' cspec )* ';'? )? ')' )",
    "cspec": "names ( type? '=' exprs )?",
    "var": "'var' ( vspec | '(' ( vspec ( ';' vspec )* ';'? )? ')' )",
    "vspec": "names ( type ( '=' exprs )? | '=' exprs )",
    "typedef": "'type' ( tspec | '(' ( tspec ( ';' tspec )* ';'? )? ')' )",
    "tspec": "NAME tparams? '='? type",
    "tparams": "'[' tparam ( ',' tparam )* ','? ']'",
    "tparam": "names constraint",
    "constraint": "cterm ( '|' cterm )*",
    "cterm": "'~'? type",
    "names": "NAME ( ',' NAME )*",
    "func": "'func' params? NAME tparams? signature block?",
    "signature": "params ( params | type )?",
    "params": "'(' ( param ( ',' param )* ','? )? ')'",
    "param": "NAME? '...'? type",
    "type": "named_type | '*' type | '[' ( expr | '...' )? ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | '<-' 'chan' type | 'func' signature | struct | interface | '(' type ')'",
    "named_type": "NAME ( '.' NAME )? ( '[' type ( ',' type )* ','? ']' )?",
    "struct": "'struct' '{' ( field ( ';' field )* ';'? )? '}'",
    "field": "( names type | '*'? named_type ) STR?",
    "interface": "'interface' '{' ( imember ( ';' imember )* ';'? )? '}'",
    "imember": "NAME signature | constraint",
    "block": "'{' list '}'",
    "list": "( stmt? ( ';' stmt? )* )",
    "stmt": "const | var | typedef | NAME ':' stmt? | simple | 'go' expr | 'defer' expr | 'return' exprs? | ( 'break' | 'continue' | 'goto' ) NAME? | 'fallthrough' | block | if | switch | select | for",
    "simple": "exprs ( ( '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ) exprs | '++' | '--' | '<-' expr )?",
    "plain": "hexprs ( ( '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ) ( 'range' hexpr | hexprs ) | '++' | '--' | '<-' hexpr )?",
    "if": "'if' ( plain? ';' )? hexpr block ( 'else' ( if | block ) )?",
    "switch": "'switch' ( plain? ';' )? plain? '{' ( ( 'case' ( expr | type ) ( ',' ( expr | type ) )* | 'default' ) ':' list )* '}'",
    "select": "'select' '{' ( ( 'case' simple | 'default' ) ':' list )* '}'",
    "for": "'for' ( plain? ';' hexpr? ';' plain? | plain? | 'range' hexpr ) block",
    "exprs": "expr ( ',' expr )*",
    "hexprs": "hexpr ( ',' hexpr )*",
    # hexpr: in the head of a statement, where a brace begins the block and not a literal.
    "expr": "unary ( operator unary )*",
    "hexpr": "hunary ( operator hunary )*",
    "operator": "'+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&^' | '<<' | '>>' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '&&' | '||'",
    "unary": "sign* operand trailer*",
    "hunary": "sign* hoperand htrailer*",
    "sign": "'+' | '-' | '!' | '^' | '*' | '&' | '<-'",
    "operand": "hoperand | NAME ( '.' NAME )? ( '[' type ( ',' type )* ','? ']' )? literal",
    "hoperand": "NAME | NUM | STR | '(' ( expr | type ) ')' | 'func' signature block | heavy literal | heavy '(' expr ','? ')' | 'interface' '{' '}' '(' expr ')'",
    "heavy": "'[' ( expr | '...' )? ']' type | 'map' '[' type ']' type | struct | 'chan' '<-'? type | '<-' 'chan' type | 'func' signature",
    "htrailer": "trailer",
    "trailer": "'.' ( NAME | '(' ( type | 'type' ) ')' ) | '[' ( index ( ',' index )* ','? ) ']' | '[' expr? ':' expr? ( ':' expr )? ']' | '(' ( ( type | expr ) ( ',' ( expr | type ) )* '...'? ','? )? ')'",
    "index": "expr | type",
    "literal": "'{' ( element ( ',' element )* ','? )? '}'",
    "element": "( ( expr | literal ) ':' )? ( expr | literal )",
}


# Words that are keywords in places only, and names elsewhere.
def _soft(words: str) -> dict[str, str]:
    return dict.fromkeys(words.split(), "NAME")


def grammar(language: str) -> Grammar:
    return once(f"grammar of {language}", lambda: _compiled(language))


def _compiled(language: str) -> Grammar:
    if language == "python":
        return Grammar(_PYTHON, ["file", "file_36"], _soft("match case type"))
    if language == "javascript":
        return Grammar(_JAVASCRIPT, ["module", "script"], _soft("let static async of get set from as yield await"))
    if language == "java":
        return Grammar(_JAVA, ["unit", "module_unit"], _soft("var record sealed permits yield non when module open opens exports requires uses provides to with transitive"))
    if language == "go":
        return Grammar(_GO, ["file"])
    raise KeyError(language)
