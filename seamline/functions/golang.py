"""Lexical rules of Go as Java regular expressions, and column helpers built on them.

All repetition is possessive, so a megabyte-long comment, string or statement needs no deep
recursion in the regex engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pieces of Go's lexical grammar.
IDENT = r"[\p{L}_][\p{L}\p{Nd}_]*+"
NOT_IN_IDENT = r"(?<![\p{L}\p{Nd}_])"
STRING = (r'"[^"\\\n]*+(?:\\(?:[abfnrtv\\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})'
          r'[^"\\\n]*+)*+"')
RAW_STRING = r"`[^`]*+`"
RUNE = (r"'(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'")
LINE_COMMENT = r"//[^\n]*+"
BLOCK_COMMENT = r"/\*(?:[^*]++|\*(?!/))*+\*/"
NUMBER = r"(?:[0-9]|\.[0-9])(?:[eEpP][+-]|[0-9a-zA-Z_.])*+"
OPERATOR = r"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|[-+*/%&|^]=|<<|>>|&\^"
KEYWORDS = [
    "break", "case", "chan", "const", "continue", "default", "defer", "else", "fallthrough", "for",
    "func", "go", "goto", "if", "import", "interface", "map", "package", "range", "return",
    "select", "struct", "switch", "type", "var",
]

# Comments that act as directives; they end a segment and get a row of their own.
DIRECTIVE = r"go:generate|line "

# A segment: everything up to and including the next bracket, "reflect" literal or directive
# comment. A lone quote or an unclosed comment also ends one, and marks the file as ill-formed.
_FILLER = "|".join([
    r"""[^"'`/()\[\]{}]++""",
    r'(?!"reflect")' + STRING,
    RAW_STRING,
    RUNE,
    rf"//(?!{DIRECTIVE})[^\n]*+",
    rf"/\*(?!line )(?:[^*]++|\*(?!/))*+\*/",
    r"/(?![/*])",
])
_CORE = "|".join([r"[()\[\]{}]", r'"reflect"', LINE_COMMENT, BLOCK_COMMENT, r"""["'`]""", r"/\*", r"\z"])
SEGMENT = rf"(?s)(?!\z)(?:{_FILLER})*+(?:{_CORE})"
# The directive comment a segment ends with, where it ends with one.
SEGMENT_NOTE = rf"(?s)^(?:{_FILLER})*+({LINE_COMMENT}|{BLOCK_COMMENT})\z"
# A character that Go allows nowhere outside literals and comments.
STRAY_CHARACTER = r"""[^\p{L}\p{Nd}_ \t\r\n"'`!%&*+,\-./:;<=>^|~]"""

# Comments and literals, for blanking: a literal leaves its quote, a block comment its first newline.
_BLANKED = "|".join([
    r"""(")(?:[^"\\\n]|\\.)*+\"""", r"(`)[^`]*+`", r"""(')(?:[^'\\\n]|\\.)*+'""",
    LINE_COMMENT,
    r"/\*(?:[^*\n]++|\*(?!/))*+(\n?+)(?:[^*]++|\*(?!/))*+\*/",
])

# The selector chain right before an opening bracket; a leading dot means it continues an operand.
CHAIN_AT_END = rf"(?:\.\s*|{NOT_IN_IDENT}){IDENT}(?:[ \t]*+\.\s*{IDENT})*+[ \t]*+\z"

# End of a statement: a semicolon, or a newline after a token that Go ends a statement at.
# The token may be a number that ends in a dot, but not a selector that goes on in the next line.
_NUMBER_DOT = r"(?<=\.)(?<=(?<![\p{L}\p{Nd}_])[0-9][0-9_]{0,99}\.)"
STATEMENT_END = rf"""(?:;|(?=[ \t\r\n])(?:(?<=[\p{{L}}\p{{Nd}}_"'`)\]}}])|{_NUMBER_DOT})[ \t\r]*+\n)"""

# Ill-formed wherever they stand: two assignment operators in a row, and at the top level a
# declaration of names alone, with neither type nor value.
DOUBLE_ASSIGNMENT = r"(?::=|(?<![=!<>:])=)\s++(?::=|=)|:=\s*+(?::=|=)"
_END_OF_WORD = r"(?![\p{L}\p{Nd}_])"
IMPORT = rf"{STATEMENT_END}\s*+import{_END_OF_WORD}"
LATE_IMPORT = rf"(?s){STATEMENT_END}\s*+(?:var|const|type|func){_END_OF_WORD}.*{IMPORT}"
INCOMPLETE_SPEC = (rf"(?:^|{STATEMENT_END})\s*+(?:var|const)\s++{IDENT}(?:[ \t]*+,\s*+{IDENT})*+[ \t\r]*+(?:;|\n)")


# --- which tokens may follow each other -------------------------------------------------------
#
# A finite automaton over classes of tokens whose states are the class just read: each entry names what must not come
# next. It sees a segment with the bracket before it and the one it ends with, comments gone and
# literals cut down to a quote and a blank, so every two neighbours of a file meet in one segment.

_SPACE, _BLANKS = r"\s*+", r"[ \t]*+"


def _word(*names: str) -> str:
    return rf"(?:{'|'.join(names)}){_END_OF_WORD}"


_OPENS_TYPE = ["func", "map", "struct", "chan", "interface"]
_ENDS_STATEMENT = ["break", "continue", "fallthrough", "return"]
_BEGINS_STATEMENT = _word(*[k for k in KEYWORDS if k not in (*_OPENS_TYPE, "range")])
# Operators with an operand on either side that cannot begin one; `<-`, `+`, `-`, `*`, `&`, `!`, `^` and `~` can.
_BINARY = r"(?:[/%|=>]|<(?!-)|[!*+\-^&]=|&&|&\^)"
# What stands before a token is looked at behind it, so that the many characters that begin none are passed at once.
_OPERATOR_END = r"(?:[=*/%&|^<>!~]|\+(?<!\+\+)|-(?<!--))"
# What must not follow a keyword. A text may end where a directive stands.
_AFTER_WORDS = [
    # Words that need something of their own behind them, and `else` also a brace before it in the same line.
    rf"else{_END_OF_WORD}(?<!\}}[ \t\r]{{0,1000}}else)",
    rf"else{_END_OF_WORD}{_SPACE}(?!\{{|\z|{_word('if')})",
    rf"{_word('struct', 'interface', 'select')}{_SPACE}(?!\{{|\z)",
    rf"{_word('map')}{_SPACE}(?!\[|\z)",
    rf"{_word('func')}{_SPACE}(?![\p{{L}}_(]|\z)",
    rf"{_word('goto', 'package')}{_SPACE}(?![\p{{L}}_]|\z)",
    rf"{_word('default')}{_SPACE}(?!:|\z)",
    rf"{_word('if')}{_SPACE}[{{}})\],]",
    # Any keyword: operators that begin no operand, and brackets that close, where no type switch or statement ends.
    rf"{_word(*KEYWORDS)}{_SPACE}(?:[/%|,]|:?=)",
    rf"{_word(*[k for k in KEYWORDS if k != 'type'])}{_SPACE}[)\]]",
    rf"{_word(*[k for k in KEYWORDS if k not in _ENDS_STATEMENT])}{_SPACE}\}}",
    # Two keywords: only a type, `else if` and `for range`.
    rf"{_word(*[k for k in KEYWORDS if k not in (*_ENDS_STATEMENT, 'else')])}\s++{_BEGINS_STATEMENT}",
]
_AFTER_SIGNS = [
    # A bracket that opens: a binary operator, a comma, a step; a parenthesis or index also a brace.
    rf"[(\[{{]{_SPACE}(?:{_BINARY}|,|\+\+|--|\{{(?<=[(\[]\s{{0,1000}}\{{))",
    # An operator or a selector's dot: a bracket that closes, a comma, a semicolon; an operator or comma also a binary operator.
    rf"(?:{_OPERATOR_END}|\.(?<![0-9.]\.)){_SPACE}[)\]}},;]",
    rf"(?:{_OPERATOR_END}|[,:])\s++{_BINARY}",
    rf",{_SPACE}[,;]",
    # A literal: a name or another literal in the same line.
    rf"""["'`] {_BLANKS}[\p{{L}}\p{{Nd}}_"'`]""",
    rf"""[0-9](?<![\p{{L}}\p{{Nd}}_.][0-9])[0-9a-zA-Z_.]*+[ \t]++[\p{{L}}_"'`]""",
    # A name, literal or bracket that closes: a word that begins a statement in the same line, but for `else if`.
    rf"""[ \t]++(?={_BEGINS_STATEMENT})(?<=[\p{{L}}\p{{Nd}}_"'`)\]][ \t]{{1,1000}})(?<!else[ \t]{{1,1000}})""",
]
# Most characters begin nothing of this and are passed by one look at a table, which a class of single characters is, not one of
# ranges: first all that a sign, digit or blank begins, then the first letters of keywords, most of which lie within a word.
_SIGNS = r"""[(\[{=*/%&|^<>!~+\-.,:"'`0123456789 \t]"""
_MUST_NOT_FOLLOW = [
    rf"(?={_SIGNS})(?:{'|'.join(_AFTER_SIGNS)})",
    rf"(?=[bcdefgimprstv])(?<![abcdefghijklmnopqrstuvwxyz])(?<![\p{{L}}\p{{Nd}}_])(?={_word(*KEYWORDS)})(?:{'|'.join(_AFTER_WORDS)})",
]
MALFORMED = "|".join(_MUST_NOT_FOLLOW)


def newlines(text: Column) -> Column:
    """Line ends of a text. Counted in bytes, which are known; characters would have to be counted, too."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def is_closer(c: Column) -> Column:
    return F.contains(F.lit(")]}"), c)


def is_opener(c: Column) -> Column:
    """An opening bracket; ``{{`` stands for the one that opens an interface body."""
    return F.contains(F.lit("([{{"), c)


def is_bracket(c: Column) -> Column:
    return F.contains(F.lit("()[]{}"), c)


def blank_literals(text: Column) -> Column:
    """Text without comments, each literal reduced to its quote character and a space."""
    touched = (F.contains(text, F.lit("/")) | F.contains(text, F.lit('"'))
               | F.contains(text, F.lit("`")) | F.contains(text, F.lit("'")))
    return F.when(touched, F.regexp_replace(text, _BLANKED, "$1$2$3$4 ")).otherwise(text)


def without_comments(text: Column) -> Column:
    """Text without comments, literals kept; a comment over several lines leaves one newline."""
    keep = rf"({STRING}|{RAW_STRING}|{RUNE})"
    drop = rf"{LINE_COMMENT}|/\*(?:[^*\n]++|\*(?!/))*+(\n?+)(?:[^*]++|\*(?!/))*+\*/"
    return F.regexp_replace(text, f"{keep}|{drop}", "$1$2")


def code_lines(text: Column) -> Column:
    """Lines that hold something other than blanks and comments."""
    return F.regexp_count(without_comments(text), F.lit(r"(?md)^[ \t\r\f\x0B]*+[^\s]")).cast("long")


def first_package_word(text: Column) -> Column:
    """Word after the first ``package`` anywhere in the raw text, else blank (ASCII word classes)."""
    return F.regexp_extract(text, r"(?<![A-Za-z0-9_])package[\t\n\f\r ]+([A-Za-z0-9_]+)", 1)


def well_encoded(text: Column) -> Column:
    """What the Go scanner accepts as text: UTF-8, no NUL, a byte-order mark only at the start."""
    return (F.is_valid_utf8(text)
            & ~F.contains(text, F.lit("\0"))
            & ~(F.contains(text, F.lit("\ufeff")) & F.contains(F.substring(text, 2, 2147483647), F.lit("\ufeff"))))
