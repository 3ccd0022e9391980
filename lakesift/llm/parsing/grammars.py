"""Grammars of the languages, in the notation of ``lr``. Operator precedence plays no part in validity and is left out."""

JS_RESERVED = (
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new "
    "return super switch this throw try typeof var void while with null true false enum"
).split()

_JS_STATEMENTS = """
Program : Stmt* ;
Block : '{' Stmt* '}' ;
Stmt : Block | ';' | Var ';' | Expr ';' | 'if' '(' Expr ')' Stmt ('else' Stmt)? | 'while' '(' Expr ')' Stmt
  | 'do' Stmt 'while' '(' Expr ')' ';'? | 'for' 'await'? '(' ForHead ')' Stmt | 'return' Expr? ';' | 'throw' Expr ';' | 'break' NAME? ';' | 'continue' NAME? ';'
  | 'debugger' ';' | 'try' Block Catch | 'switch' '(' Expr ')' '{' Case* '}' | NAME ':' Stmt | 'with' '(' Expr ')' Stmt | Function | Class | Import | Export @MORESTMT ;
Catch : 'catch' ('(' Binding @ANN ')')? Block ('finally' Block)? | 'finally' Block ;
Case : ('case' Expr | 'default') ':' Stmt* ;
VarWord : 'var' | 'let' | 'const' | 'using' ;
Var : VarWord (Declarator % ',') ;
Declarator : Binding @BANG @ANN ('=' Assign)? ;
ForHead : (Var | Expr)? ';' Expr? ';' Expr? | VarWord Binding ('of' Assign | 'in' Expr) | Lhs ('of' Assign | 'in' Expr) ;
Binding : NAME | '{' (BindProp % ',')? ','? '}' | '[' BindElems ']' ;
BindProp : NAME ('=' Assign)? | PropName ':' Binding ('=' Assign)? | '...' NAME ;
BindElems : BindElem? (',' BindElem?)* ;
BindElem : Binding ('=' Assign)? | '...' Binding ;
Function : 'async'? 'function' '*'? NAME Signature Block @OVERLOAD ;
Signature : @TPARAMS Params @RET ;
Params : '(' ((Param % ',') ','?)? ')' ;
Param : @DECOR @ACCESS Binding @OPT @ANN ('=' Assign)? | @DECOR @ACCESS '...' Binding @ANN @THISPARAM ;
Class : @DECOR @ABSTRACT 'class' NAME? @TPARAMS ('extends' Lhs @TARGS)? @IMPLEMENTS ClassBody ;
ClassBody : '{' Member* '}' ;
Member : ';' | 'static' Block | @DECOR Modifier* Key Signature Block | @DECOR Modifier* Key @OPTBANG @ANN ('=' Assign)? ';' @MOREMEMBER ;
Modifier : 'static' | 'async' | 'get' | 'set' | '*' | 'accessor' @MODIFIERS ;
Key : PropName | PRIVATE ;
PropName : NAME | STR | NUM | '[' Assign ']' | Reserved ;
Reserved : @RESERVED ;
Import : 'import' @TYPEWORD ImportClause 'from' STR With? ';' | 'import' STR With? ';' ;
With : 'with' Object ;
ImportClause : NAME | NAME ',' Named | NAME ',' Star | Named | Star ;
Star : '*' 'as' NAME ;
Named : '{' ((Spec % ',') ','?)? '}' ;
Spec : @TYPEWORD ModuleName ('as' ModuleName)? ;
ModuleName : NAME | STR | Reserved ;
Export : 'export' (Var ';' | Function | Class) | 'export' 'default' (Assign ';' | Function | Class | Anonymous @EXPORTDEFAULT) | 'export' @TYPEWORD Named ('from' STR With?)? ';'
  | 'export' @TYPEWORD '*' ('as' ModuleName)? 'from' STR With? ';' | Decorators 'export' 'default'? Class @MOREEXPORT ;
Anonymous : 'async'? 'function' '*'? Signature Block ;
Expr : Assign % ',' ;
Assign : Cond | Lhs AssignOp Assign | Arrow | 'yield' ('*'? Assign)? ;
AssignOp : '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>' '>=' | '>' '>' '>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' ;
Arrow : 'async'? (NAME | Signature) '=>' (Assign | Block) ;
Cond : Binary ('?' Assign ':' Assign)? ;
Binary : Unary | Binary BinOp Unary @ASTYPE ;
BinOp : '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '&' | '|' | '^' | '&&' | '||' | '??' | 'in' | 'instanceof' ;
Unary : Postfix | ('!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await') Unary @CAST ;
Postfix : Lhs ('++' | '--')? ;
Lhs : Primary | Lhs ('.' | '?.') (NAME | PRIVATE) | Lhs '?.'? '[' Expr ']' | Lhs '?.'? Args | Lhs Template | 'new' Lhs | 'new' '.' NAME | 'import' Args | 'import' '.' NAME @MORELHS ;
Args : '(' ((Arg % ',') ','?)? ')' ;
Arg : '...'? Assign ;
Template : TEMPLATE | T_HEAD Expr (T_MIDDLE Expr)* T_TAIL ;
Primary : NAME | NUM | STR | REGEX | Jsx | Template | PRIVATE | 'this' | 'super' | 'null' | 'true' | 'false' | '(' Expr ')' | '[' Elems ']' | Object
  | 'async'? 'function' '*'? NAME? Signature Block | 'class' NAME? @TPARAMS ('extends' Lhs @TARGS)? @IMPLEMENTS ClassBody ;
Jsx : JSX | J_HEAD JsxHole (J_MIDDLE JsxHole)* J_TAIL ;
JsxHole : Expr | '...' Assign ;
Elems : Arg? (',' Arg?)* ;
Object : '{' ((Prop % ',') ','?)? '}' ;
Prop : PropName ':' Assign | NAME ('=' Assign)? | '...' Assign | ObjModifier* PropName Signature Block ;
ObjModifier : 'async' | 'get' | 'set' | '*' ;
"""

_TS_TYPES = """
Type : Union | Union 'extends' Union '?' Type ':' Type | TypeParams? Params '=>' Type | 'abstract'? 'new' TypeParams? Params '=>' Type | NAME 'is' Type
  | 'this' 'is' Type | 'asserts' (NAME | 'this') ('is' Type)? ;
Union : '|'? (Inter % '|') ;
Inter : '&'? (Operand % '&') ;
Operand : Plain | ('keyof' | 'readonly' | 'unique' | 'typeof') Operand | 'infer' NAME ('extends' Operand)? ;
Plain : Core | Plain '[' Type? ']' ;
Core : TypeName TypeArgs? | STR | NUM | '-' NUM | TypeTemplate | 'true' | 'false' | 'null' | 'void' | 'this' | '(' Type ')' | '{' TypeMembers? '}' | '[' ((TupleItem % ',') ','?)? ']'
  | 'import' '(' STR ')' ('.' TypeName)? TypeArgs? ;
TypeTemplate : TEMPLATE | T_HEAD Type (T_MIDDLE Type)* T_TAIL ;
TypeName : NAME | TypeName '.' NAME ;
TypeArgs : '<' (Type % ',') ','? '>' ;
TypeParams : '<' (TypeParam % ',') ','? '>' ;
TypeParam : ('const' | 'in' | 'out')* NAME ('extends' Type)? ('=' Type)? ;
TupleItem : '...'? Type '?'? | '...'? NAME '?'? ':' Type ;
TypeMembers : TypeMember | TypeMembers (';' | ',') TypeMember? ;
TypeMember : TypeModifier* PropName '?'? Ann? | TypeModifier* PropName '?'? TypeParams? Params Ann? | 'new'? TypeParams? Params Ann? | ('+' | '-')? 'readonly'? '[' NAME ':' Type ']' Ann
  | (('+' | '-')? 'readonly')? '[' NAME 'in' Type ('as' Type)? ']' (('+' | '-')? '?')? Ann? ;
TypeModifier : 'readonly' | 'get' | 'set' | 'static' ;
Ann : ':' Type ;
Decorators : ('@' Lhs)+ ;
Interface : 'interface' NAME TypeParams? ('extends' (TypeRef % ','))? '{' TypeMembers? '}' ;
TypeRef : TypeName TypeArgs? ;
Alias : 'type' NAME TypeParams? '=' Type ';' ;
Enum : 'const'? 'enum' NAME '{' ((EnumItem % ',') ','?)? '}' ;
EnumItem : PropName ('=' Assign)? ;
Namespace : ('namespace' | 'module') (TypeName | STR) Block | 'global' Block ;
Ambient : Interface | Alias | Enum | Namespace ;
Declared : Var ';' | 'async'? 'function' '*'? NAME Signature ';' | Class | Ambient ;
"""

_TS = {
    "MORESTMT": "| Ambient | 'declare' Declared | 'import' NAME '=' (Lhs) ';' | 'abstract' Class",
    "ANN": "Ann?",
    "BANG": "'!'?",
    "OVERLOAD": "| 'async'? 'function' '*'? NAME Signature ';'",
    "TPARAMS": "TypeParams?",
    "RET": "Ann?",
    "DECOR": "Decorators?",
    "ACCESS": "('public' | 'private' | 'protected' | 'readonly' | 'override')*",
    "OPT": "'?'?",
    "THISPARAM": "| 'this' Ann",
    "ABSTRACT": "'abstract'?",
    "TARGS": "TypeArgs?",
    "IMPLEMENTS": "('implements' (TypeRef % ','))?",
    "OPTBANG": "('?' | '!')?",
    "MOREMEMBER": "| Decorators? Modifier* Key '?'? Signature ';' | Decorators? Modifier* Key '?' Signature Block | Modifier* '[' NAME ':' Type ']' Ann ';'",
    "MODIFIERS": "| 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare'",
    "TYPEWORD": "'type'?",
    "EXPORTDEFAULT": "| Interface",
    "MOREEXPORT": "| 'export' (Ambient | 'declare' Declared) | 'export' '=' Expr ';' | 'export' 'as' 'namespace' NAME ';' | 'export' 'import' NAME '=' Lhs ';'",
    "ASTYPE": "| Binary ('as' | 'satisfies') (Type | 'const')",
    "CAST": "| '<' Type '>' Unary",
    "MORELHS": "| Lhs '!' | Lhs '?.'? TypeArgs Args | Lhs TypeArgs Template | 'new' Lhs TypeArgs",
}
JS_CONTEXTUAL = {"let", "of", "async", "get", "set", "static", "as", "from", "yield", "await", "accessor", "using"}
TS_CONTEXTUAL = JS_CONTEXTUAL | {
    "is", "asserts", "keyof", "readonly", "unique", "infer", "out", "type", "interface", "namespace", "module", "global", "declare", "abstract", "implements", "public",
    "private", "protected", "override", "satisfies",
}


def _fill(text: str, parts: dict[str, str]) -> str:
    import re

    parts = parts | {"RESERVED": " | ".join(f"'{w}'" for w in JS_RESERVED)}
    return re.sub(r"@(\w+)", lambda m: parts.get(m[1], ""), text)


JAVASCRIPT = _fill(_JS_STATEMENTS, {"DECOR": "Decorators?"}) + "Decorators : ('@' Lhs)+ ;"
TYPESCRIPT = _fill(_JS_STATEMENTS, _TS) + _TS_TYPES

GO_KEYWORDS = (
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
).split()
GO = """
File : 'package' NAME ';' (ImportDecl ';')* (TopDecl ';')* ;
ImportDecl : 'import' (ImportSpec | '(' ((ImportSpec % ';') ';'?)? ')') ;
ImportSpec : (NAME | '.')? STR ;
TopDecl : Decl | 'func' Receiver? NAME TypeParams? Signature Block? ;
Receiver : Params ;
Decl : 'const' (ConstSpec | '(' ((ConstSpec % ';') ';'?)? ')') | 'var' (VarSpec | '(' ((VarSpec % ';') ';'?)? ')') | 'type' (TypeSpec | '(' ((TypeSpec % ';') ';'?)? ')') ;
ConstSpec : Names (Type? '=' Exprs)? ;
VarSpec : Names Type ('=' Exprs)? | Names '=' Exprs ;
TypeSpec : NAME TypeParams? '='? Type ;
TypeParams : '[' (TypeParam % ',') ','? ']' ;
TypeParam : Names Constraint ;
Constraint : '~'? Type ('|' '~'? Type)* ;
Names : NAME % ',' ;
Exprs : Expr % ',' ;
Signature : Params Result? ;
Result : Params | Type ;
Params : '(' ((Param % ',') ','?)? ')' ;
Param : Type | NAME Type | NAME? '...' Type ;
Type : TypeName | '*' Type | '[' ']' Type | '[' (Expr | '...') ']' Type | 'map' '[' Type ']' Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' Signature
  | 'struct' '{' ((Field % ';') ';'?)? '}' | 'interface' '{' ((Element % ';') ';'?)? '}' | '(' Type ')' ;
TypeName : QName | QName '[' (Type % ',') ','? ']' ;
QName : NAME | NAME '.' NAME ;
Field : Names Type STR? | '*'? TypeName STR? ;
Element : NAME Signature | Constraint ;
Block : '{' Stmts? '}' ;
Stmts : Stmt | Stmts ';' | Stmts ';' Stmt | ';' | ';' Stmt ;
Stmt : Decl | Simple | 'return' Exprs? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | Block | If | Switch | Select | For | 'defer' Expr | 'go' Expr | NAME ':' Stmt? ;
Simple : Expr | Expr '<-' Expr | Expr ('++' | '--') | Exprs AssignOp Exprs | Exprs ':=' Exprs ;
AssignOp : '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ;
If : 'if' (Simple? ';')? Expr Block ('else' (If | Block))? ;
Switch : 'switch' (Simple? ';')? (Simple)? '{' Clause* '}' ;
Clause : ('case' (CaseItem % ',') | 'default') ':' Stmts? ;
CaseItem : Expr | Type ;
Select : 'select' '{' CommClause* '}' ;
CommClause : ('case' Simple | 'default') ':' Stmts? ;
For : 'for' (Expr | Simple? ';' Expr? ';' Simple? | (Exprs ('=' | ':='))? 'range' Expr)? Block ;
Expr : Unary | Expr BinOp Unary ;
BinOp : '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^' ;
Unary : Primary | ('+' | '-' | '!' | '^' | '*' | '&' | '<-') Unary ;
Primary : NAME | NUM | STR | CHAR | '(' Expr ')' | Literal | 'func' Signature Block | Primary '.' NAME | Primary '.' '(' ('type' | Type) ')' | Primary '[' Index ']' | Primary Args | Conversion ;
Conversion : ('[' ']' Type | '[' (Expr | '...') ']' Type | 'map' '[' Type ']' Type | 'chan' Type | 'interface' '{' '}' | 'struct' '{' '}' | '(' '*' Type ')' | 'func' Signature) '(' Expr ','? ')' ;
Index : Expr | Expr? ':' Expr? | Expr? ':' Expr ':' Expr | Type (',' Type)+ | Type ;
Args : '(' ((Arg % ',') '...'? ','?)? ')' ;
Arg : Expr | Type ;
Literal : LiteralType Body ;
LiteralType : TypeName | '[' ']' Type | '[' (Expr | '...') ']' Type | 'map' '[' Type ']' Type | 'struct' '{' ((Field % ';') ';'?)? '}' ;
Body : '{' ((Item % ',') ','?)? '}' ;
Item : (Value ':')? Value ;
Value : Expr | Body ;
"""

JAVA_KEYWORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import "
    "instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void "
    "volatile while true false null"
).split()
JAVA_CONTEXTUAL = {"record", "var", "yield", "sealed", "permits", "non", "when", "module", "open", "requires", "exports", "opens", "uses", "provides", "to", "with", "transitive", "_"}
JAVA = """
Unit : Package? Import* TypeDecl* | Import* Annotation* 'open'? 'module' QName '{' Directive* '}' ;
Directive : 'requires' ('transitive' | 'static')* QName ';' | ('exports' | 'opens') QName ('to' (QName % ','))? ';' | 'uses' QName ';' | 'provides' QName 'with' (QName % ',') ';' ;
Package : Annotation* 'package' QName ';' ;
Import : 'import' 'static'? QName ('.' '*')? ';' | 'import' 'module' QName ';' | ';' ;
QName : NAME | QName '.' NAME ;
Annotation : '@' QName AnnoArgs? ;
AnnoArgs : '(' ((AnnoArg % ',') ','?)? ')' ;
AnnoArg : NAME '=' AnnoValue | AnnoValue ;
AnnoValue : Cond | Annotation | '{' ((AnnoValue % ',') ','?)? '}' ;
Modifier : Annotation | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed' ;
TypeDecl : Modifier* (Class | Interface | Enum | Record | AnnoType) | ';' | Method ;
Class : 'class' NAME TypeParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? ClassBody ;
Interface : 'interface' NAME TypeParams? ('extends' Types)? ('permits' Types)? ClassBody ;
AnnoType : '@' 'interface' NAME '{' AnnoMember* '}' ;
AnnoMember : Member | Modifier* Type NAME '(' ')' 'default' AnnoValue ';' ;
Enum : 'enum' NAME ('implements' Types)? '{' ((EnumItem % ',') ','?)? (';' Member*)? '}' | 'enum' NAME ('implements' Types)? '{' ','? (';' Member*)? '}' ;
EnumItem : Annotation* NAME Args? ClassBody? ;
Record : 'record' NAME TypeParams? '(' (RecordPart % ',')? ')' ('implements' Types)? ClassBody ;
RecordPart : Annotation* Type '...'? NAME ;
ClassBody : '{' Member* '}' ;
Member : ';' | 'static'? Block | Modifier* Field | Method | Modifier* (Class | Interface | Enum | Record | AnnoType) | Modifier* TypeParams? NAME Params Throws? Block | Modifier* NAME Block ;
Field : Type (Declarator % ',') ';' ;
Method : Modifier* TypeParams? Annotation* Result NAME Params Dims? Throws? (Block | ';') ;
Result : Type | 'void' ;
Throws : 'throws' Types ;
Params : '(' (Param % ',')? ')' ;
Param : Modifier* Type Annotation* '...'? NAME Dims? | Modifier* Type (NAME '.')? 'this' ;
Declarator : NAME Dims? ('=' Init)? ;
Dims : (Annotation* '[' ']')+ ;
Init : Expr | ArrayInit ;
ArrayInit : '{' ((Init % ',') ','?)? '}' ;
TypeParams : '<' (TypeParam % ',') '>' ;
TypeParam : Annotation* NAME ('extends' (Type % '&'))? ;
Types : Type % ',' ;
Prim : 'boolean' | 'byte' | 'char' | 'double' | 'float' | 'int' | 'long' | 'short' ;
Type : Annotation* (Prim | ClassType) Dims? ;
ClassType : NAME TypeArgs? | ClassType '.' Annotation* NAME TypeArgs? ;
TypeArgs : '<' (TypeArg % ',')? '>' ;
TypeArg : Type | Annotation* '?' (('extends' | 'super') Type)? ;
Block : '{' BlockStmt* '}' ;
BlockStmt : Stmt | Modifier* Local ';' | Modifier* (Class | Interface | Enum | Record) ;
Local : Type (Declarator % ',') ;
Stmt : Block | ';' | StmtExpr ';' | 'if' '(' Expr ')' Stmt ('else' Stmt)? | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';'
  | 'for' '(' ForInit? ';' Expr? ';' (StmtExpr % ',')? ')' Stmt | 'for' '(' Modifier* Type NAME ':' Expr ')' Stmt | 'return' Expr? ';' | 'throw' Expr ';' | 'break' NAME? ';' | 'continue' NAME? ';'
  | 'yield' Expr ';' | 'assert' Expr (':' Expr)? ';' | 'synchronized' '(' Expr ')' Block | NAME ':' Stmt | Switch | 'try' Resources? Block ('catch' '(' Modifier* (Type % '|') NAME ')' Block)* ('finally' Block)? ;
ForInit : Modifier* Local | StmtExpr % ',' ;
Resources : '(' (Resource % ';') ';'? ')' ;
Resource : Modifier* Type NAME '=' Expr | Expr ;
Switch : 'switch' '(' Expr ')' '{' (Group* | Rule+) '}' ;
Group : Label ':' BlockStmt* ;
Rule : Label '->' (Expr ';' | Block | 'throw' Expr ';') ;
Label : 'case' (CaseItem % ',') ('when' Expr)? | 'default' ;
CaseItem : Cond | Pattern | 'default' ;
Pattern : '_' | Modifier* Type NAME | Modifier* Type '(' (Pattern % ',')? ')' NAME? ;
StmtExpr : Unary AssignOp Expr | ('++' | '--') Unary | Postfix ('++' | '--') | CallLike ;
CallLike : Postfix '.' TypeArgs? NAME Args | NAME Args | ('this' | 'super') Args | Postfix '.' 'super' Args | New ;
Expr : Cond | Unary AssignOp Expr | Lambda ;
AssignOp : '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>=' ;
Lambda : (NAME | '(' (LambdaParam % ',')? ')') '->' (Expr | Block) ;
LambdaParam : NAME | Modifier* Type '...'? NAME ;
Cond : Binary ('?' Expr ':' (Cond | Lambda))? ;
Binary : Unary | Binary BinOp Unary | Binary 'instanceof' (Type | Pattern) ;
BinOp : '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%' ;
Unary : Postfix | Postfix ('++' | '--') | ('+' | '-' | '!' | '~' | '++' | '--') Unary | '(' Type ('&' Type)* ')' (Unary | Lambda) ;
Postfix : NAME | NUM | STR | CHAR | 'true' | 'false' | 'null' | 'this' | 'super' | '(' Expr ')' | New | Postfix '.' NAME | Postfix '.' 'this' | Postfix '.' 'super' | Postfix '.' New | Postfix '.' TypeArgs? NAME Args | NAME Args
  | ('this' | 'super') Args | Postfix '[' Expr ']' | Postfix '.' 'class' | (Prim | 'void') Dims? '.' 'class' | ClassType Dims '.' 'class' | (Postfix | Type) '::' TypeArgs? (NAME | 'new') | Switch ;
New : 'new' TypeArgs? Annotation* ClassType Args ClassBody? | 'new' (Prim | ClassType) ('[' Expr ']')+ Dims? | 'new' (Prim | ClassType) Dims ArrayInit ;
Args : '(' (Expr % ',')? ')' ;
"""

CSHARP_KEYWORDS = (
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed "
    "float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref "
    "return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while"
).split()
CSHARP_CONTEXTUAL = {
    "get", "set", "init", "add", "remove", "record", "var", "await", "async", "yield", "where", "when", "partial", "global", "alias", "required", "scoped", "file", "and", "or", "not", "with", "nameof",
    "from", "select", "orderby", "group", "by", "into", "let", "join", "on", "equals", "ascending", "descending", "unmanaged", "notnull", "managed", "field", "dynamic",
}
CSHARP = """
Unit : Extern* Using* GlobalAttr* UnitItem* ;
Extern : 'extern' 'alias' NAME ';' ;
Using : 'global'? 'using' ('static' | 'unsafe')? Type ';' | 'global'? 'using' NAME '=' Type ';' ;
GlobalAttr : '[' NAME ':' (Attr % ',') ','? ']' ;
UnitItem : 'namespace' QName ';' Using* | 'namespace' QName '{' Extern* Using* UnitItem* '}' ';'? | TypeDecl | Stmt | LocalFunction ;
QName : NAME | QName '.' NAME | NAME '::' NAME ;
AttrList : '[' (NAME ':' | 'return' ':' | 'event' ':')? (Attr % ',') ','? ']' ;
Attr : Type AttrArgs? ;
AttrArgs : '(' (AttrArg % ',')? ')' ;
AttrArg : ((NAME '=') | (NAME ':'))? Expr ;
Modifier : 'public' | 'private' | 'protected' | 'internal' | 'static' | 'abstract' | 'sealed' | 'virtual' | 'override' | 'readonly' | 'extern' | 'unsafe' | 'volatile' | 'new' | 'const' | 'async' | 'partial' | 'required' | 'file' | 'ref' | 'fixed' ;
TypeDecl : AttrList* Modifier* (Class | Enum | Delegate) ;
ClassWord : 'class' | 'struct' | 'interface' | 'record' | 'record' 'class' | 'record' 'struct' ;
Class : ClassWord NAME TypeParams? Params? (':' (BaseItem % ','))? Where* (ClassBody ';'? | ';') ;
BaseItem : Type Args? ;
TypeParams : '<' (AttrList* ('in' | 'out')? NAME) (',' AttrList* ('in' | 'out')? NAME)* '>' ;
Where : 'where' NAME ':' (Bound % ',') ;
Bound : Type | 'class' '?'? | 'struct' | 'new' '(' ')' | 'default' | 'unmanaged' | 'notnull' ;
Enum : 'enum' NAME (':' Type)? '{' ((EnumItem % ',') ','?)? '}' ';'? ;
EnumItem : AttrList* NAME ('=' Expr)? ;
Delegate : 'delegate' ReturnType NAME TypeParams? Params Where* ';' ;
ClassBody : '{' Member* '}' ;
Member : TypeDecl | AttrList* Modifier* MemberRest ;
MemberRest : 'event'? Type (Declarator % ',') ';' | ReturnType MemberName TypeParams? Params Where* Body | Type MemberName Accessors ('=' Expr ';')? | Type MemberName '=>' Expr ';'
  | 'event' Type MemberName Accessors | Type (Type '.')? 'this' '[' (Param % ',') ']' (Accessors | '=>' Expr ';') | NAME Params (':' ('base' | 'this') Args)? Body | '~' NAME '(' ')' Body
  | ReturnType 'operator' 'checked'? Overloadable Params Body | ('implicit' | 'explicit') 'operator' Type Params Body ;
Overloadable : '+' | '-' | '!' | '~' | '++' | '--' | 'true' | 'false' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>' '>' | '==' | '!=' | '<' | '>' | '<=' | '>=' ;
MemberName : NAME | Type '.' NAME ;
ReturnType : Type | 'void' | 'ref' 'readonly'? Type ;
Body : Block ';'? | '=>' Expr ';' | ';' ;
Accessors : '{' Accessor+ '}' ;
Accessor : AttrList* ('public' | 'private' | 'protected' | 'internal' | 'readonly')* ('get' | 'set' | 'init' | 'add' | 'remove') Body ;
Params : '(' (Param % ',')? ')' ;
Param : AttrList* ('ref' | 'out' | 'in' | 'this' | 'params' | 'scoped' | 'readonly')* Type NAME ('=' Expr)? ;
Declarator : NAME ('=' Init)? | NAME '[' Expr ']' ;
Init : Expr | '{' ((Init % ',') ','?)? '}' | 'ref' Expr ;
Builtin : 'bool' | 'byte' | 'char' | 'decimal' | 'double' | 'float' | 'int' | 'long' | 'object' | 'sbyte' | 'short' | 'string' | 'uint' | 'ulong' | 'ushort' ;
Type : CoreType | Type '?' | Type '[' ','* ']' | Type '*' | 'void' '*' ;
CoreType : Builtin | NamedType | '(' TupleItem (',' TupleItem)+ ')' | 'delegate' '*' TypeArgs ;
TupleItem : Type NAME? ;
NamedType : NAME TypeArgs? | NAME '::' NAME TypeArgs? | NamedType '.' NAME TypeArgs? ;
TypeArgs : '<' (((Type | 'void') % ',') | ','*) '>' ;
Block : '{' BlockStmt* '}' ;
BlockStmt : Stmt | LocalFunction ;
LocalFunction : AttrList* ('static' | 'async' | 'unsafe' | 'extern')* ReturnType NAME TypeParams? Params Where* Body ;
Local : ('const' | 'ref' | 'ref' 'readonly' | 'scoped')? Type (Declarator % ',') ;
Stmt : Block | ';' | Local ';' | StmtExpr ';' | 'if' '(' Expr ')' Stmt ('else' Stmt)? | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';' | 'for' '(' ForInit? ';' Expr? ';' (StmtExpr % ',')? ')' Stmt
  | 'await'? 'foreach' '(' ('ref' 'readonly'?)? Type Target 'in' Expr ')' Stmt | 'return' 'ref'? Expr? ';' | 'throw' Expr? ';' | 'break' ';' | 'continue' ';' | 'goto' (NAME | 'case' Expr | 'default') ';' | 'yield' ('return' Expr | 'break') ';'
  | NAME ':' Stmt | ('checked' | 'unchecked' | 'unsafe') Block | 'lock' '(' Expr ')' Stmt | 'fixed' '(' Local ')' Stmt | 'await'? 'using' '(' (Local | Expr) ')' Stmt | 'await'? 'using' Local ';'
  | 'switch' '(' Expr ')' '{' Section* '}' | 'switch' TupleExpr '{' Section* '}' | 'try' Block CatchClause* ('finally' Block)? ;
Target : NAME | '(' (Target % ',') ')' ;
CatchClause : 'catch' ('(' Type NAME? ')')? ('when' '(' Expr ')')? Block ;
ForInit : Local | StmtExpr % ',' ;
Section : Label+ BlockStmt+ ;
Label : 'case' Pattern ('when' Expr)? ':' | 'default' ':' ;
StmtExpr : Unary AssignOp AssignValue | ('++' | '--') Unary | Postfix ('++' | '--') | Postfix Args | Postfix '?' Chain | New | 'await' Unary | DeclTuple '=' Expr ;
DeclTuple : 'var' '(' (Target % ',') ')' | '(' Type NAME (',' Type NAME)+ ')' ;
AssignValue : Expr | 'ref' Expr ;
Expr : Cond | Unary AssignOp AssignValue | Lambda | Query | 'throw' Expr | 'ref' Expr ;
AssignOp : '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>=' | '??=' ;
Lambda : AttrList* ('async' | 'static')* (NAME | Type? '(' (LambdaParam % ',')? ')') '=>' (Expr | Block) | ('async' | 'static')* 'delegate' Params? Block ;
LambdaParam : NAME | AttrList* ('ref' | 'out' | 'in' | 'params')? Type NAME ('=' Expr)? ;
Query : 'from' Type? NAME 'in' Expr QueryClause* ('select' Expr | 'group' Expr 'by' Expr) ('into' NAME QueryClause* ('select' Expr | 'group' Expr 'by' Expr))* ;
QueryClause : 'from' Type? NAME 'in' Expr | 'let' NAME '=' Expr | 'where' Expr | 'join' Type? NAME 'in' Expr 'on' Expr 'equals' Expr ('into' NAME)? | 'orderby' (Order % ',') ;
Order : Expr ('ascending' | 'descending')? ;
Cond : Binary ('?' Expr ':' Expr)? ;
Binary : Unary | Binary BinOp Unary | Binary 'is' Pattern | Binary 'as' Type | Binary 'switch' '{' ((Arm % ',') ','?)? '}' | Binary 'with' ObjectInit | Binary '??' ('throw' Expr) ;
Arm : Pattern ('when' Expr)? '=>' Expr ;
Pattern : PatternUnary (('and' | 'or') PatternUnary)* ;
PatternUnary : 'not' PatternUnary | Cond | Type NAME? | 'var' Target | ('<' | '>' | '<=' | '>=') Binary | Type? '(' (SubPattern % ',')? ')' PropPattern? NAME? | Type? PropPattern NAME? | '[' ((ListPattern % ',') ','?)? ']' NAME? | '(' Pattern ')' ;
ListPattern : Pattern | '..' Pattern? ;
PropPattern : '{' ((SubPattern % ',') ','?)? '}' ;
SubPattern : (QName ':')? Pattern ;
BinOp : '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%' | '??' | '..' ;
Unary : Postfix | Postfix ('++' | '--' | '..') | ('+' | '-' | '!' | '~' | '++' | '--' | '^' | '&' | '*' | '..') Unary | 'await' Unary | '(' Type ')' Unary ;
TupleExpr : '(' TupleArg (',' TupleArg)+ ')' ;
TupleArg : (NAME ':')? Expr | Type NAME ;
Postfix : NAME TypeArgs? | Builtin | NUM | STR | Interpolated | CHAR | 'true' | 'false' | 'null' | 'this' | 'base' | '(' Expr ')' | TupleExpr | New | Postfix ('.' | '->') NAME TypeArgs? | NAME '::' NAME | Postfix Args | Postfix '[' (Arg % ',') ']'
  | Postfix '?' Chain | Postfix '!' | 'typeof' '(' (Type | 'void') ')' | 'default' ('(' Type ')')? | 'sizeof' '(' Type ')' | ('checked' | 'unchecked') '(' Expr ')' | 'stackalloc' Type? '[' Expr? ']' ArrayInit? | '[' ((Element % ',') ','?)? ']' ;
Interpolated : I_HEAD Hole (I_MIDDLE Hole)* I_TAIL ;
Hole : Expr (',' Expr)? ;
Element : Expr | '..' Expr ;
Chain : '.' NAME TypeArgs? | '[' (Arg % ',') ']' ;
New : 'new' Type Args ObjectInit? | 'new' Type ObjectInit | 'new' Args ObjectInit? | 'new' NewArray | 'new' '{' ((Anon % ',') ','?)? '}' ;
NewArray : (CoreType | Type '?') '[' (Expr % ',') ']' ('[' ','* ']')* ArrayInit? | Type ArrayInit | '[' ','* ']' ArrayInit ;
ArrayInit : '{' ((Init % ',') ','?)? '}' ;
ObjectInit : '{' ((InitItem % ',') ','?)? '}' ;
InitItem : NAME '=' (Expr | ObjectInit) | '[' (Arg % ',') ']' '=' (Expr | ObjectInit) | Expr | '{' (Expr % ',') ','? '}' ;
Anon : NAME '=' Expr | Expr ;
Args : '(' (Arg % ',')? ')' ;
Arg : (NAME ':')? (Expr | ('ref' | 'in') Expr | 'out' Expr | 'out' Type NAME) ;
"""
