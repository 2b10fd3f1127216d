"""Text functions over SQL and templated SQL, as Column expressions.

Templated SQL is read by the grammar of templates: it is cut into plain text, comments, statements
and expressions; statements choose what stays (of a conditional its else branch, or its first one
without an else; definitions of macros and block variables not at all); every expression that stays
is rendered by what it is. The text of a raw block stays as it is. A quote inside a statement or expression hides
its end marks, also where plain SQL text holds a literal start mark, as templates would read it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INSIDE = r"""(?:[^'"%}]++|'[^']*+'|"[^"]*+"|[%}](?!\}))*+"""
_RAW, _END_RAW = r"\{%[-+]?\s*raw\s*[-+]?%\}", r"\{%[-+]?\s*endraw\s*[-+]?%\}"
#: Raw blocks, comments, statements, expressions, and runs of plain text.
PIECE = rf"(?s){_RAW}.*?{_END_RAW}|\{{#.*?#\}}|\{{%{_INSIDE}%\}}|\{{\{{{_INSIDE}\}}\}}|[^{{]++|\{{"
ARGUMENT = r"""'[^']*'|"[^"]*"|-?\w[\w.]*"""
FRAME = "array<struct<kind:string,skip:boolean,since:int,runs:array<struct<since:int,size:int>>>>"
# Names that macros give to types.
TYPES = {"type_string": "VARCHAR", "type_int": "INTEGER", "type_timestamp": "TIMESTAMP", "type_float": "FLOAT", "type_numeric": "NUMERIC", "type_boolean": "BOOLEAN"}


def sql_hash(sql: Column) -> Column:
    """A short content key."""
    return F.substring(F.sha2(sql, 256), 1, 16)


def _frame(kind: Column, skip: Column, since: Column, runs: Column) -> Column:
    """An open statement: what it is, whether what follows goes, where its last run of pieces begins, and its runs before."""
    return F.array(F.struct(kind.alias("kind"), skip.alias("skip"), since.alias("since"), runs.alias("runs")))


def _bound(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, as the only element of an array, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _read(piece: Column) -> Column:
    """A piece with the word of its statement; a raw block is plain text, marked by ``{#``, as comments are never kept."""
    word = F.regexp_extract(piece, r"^\{%[-+]?\s*(\w+)", 1)
    raw = rf"(?s)^{_RAW}(.*){_END_RAW}$"
    return _bound(word, lambda w: F.when((w == "raw") & piece.rlike(raw), F.struct(F.lit("").alias("word"), F.concat(F.lit("{#"), F.regexp_extract(piece, raw, 1)).alias("piece"))).otherwise(F.struct(w.alias("word"), piece.alias("piece"))))


def _kept_pieces(sql: Column) -> Column:
    """The pieces that conditionals and definitions leave, in order; inline assignments are among them."""
    pieces = F.filter(F.regexp_extract_all(sql, F.lit(PIECE), F.lit(0)), lambda x: ~F.startswith(x, F.lit("{#")))
    chosen = _bound(F.transform(pieces, _read), lambda p: F.flatten(F.transform(_kept_runs(p), lambda r: F.slice(p, r["since"] + 1, r["size"]))))
    return F.transform(F.filter(chosen, lambda x: x["word"].isin("", "set")), lambda x: x["piece"])


def _kept_runs(pieces: Column) -> Column:
    """(since, size) of the runs of pieces that stay. Only statements are gone through, and runs carried along, so plain text and expressions cost nothing here."""
    nothing = F.array().cast("array<struct<since:int,size:int>>")
    statements = F.filter(F.transform(pieces, lambda x, i: F.struct(i.alias("at"), x["word"].alias("word"), x["piece"].alias("piece"))), lambda x: x["word"] != "")
    until = lambda frame, at: F.when(frame["skip"], frame["runs"]).otherwise(F.concat(frame["runs"], F.array(F.struct(frame["since"].alias("since"), (at - frame["since"]).alias("size")))))
    but_last = lambda frames, n: F.slice(frames, F.lit(1), F.greatest(F.size(frames) - n, F.lit(0)))

    def step(frames, x):
        word, at, after, top, under = x["word"], x["at"], x["at"] + 1, F.element_at(frames, -1), F.try_element_at(frames, F.lit(-2))
        below = but_last(frames, 1)
        opens = word.isin("if", "for", "macro", "materialization", "test", "docs") | (word == "set") & ~x["piece"].contains("=")
        closes = (F.size(frames) > 1) & (word == F.concat(F.lit("end"), top["kind"]))
        left = F.when(under["skip"] | ~word.isin("endif", "endfor"), under["runs"]).otherwise(F.concat(under["runs"], until(top, at)))
        out = F.when(opens, F.concat(below, _frame(top["kind"], top["skip"], top["since"], until(top, at)), _frame(word, ~word.isin("if", "for"), after, nothing)))
        out = out.when(closes, F.concat(but_last(frames, 2), _frame(under["kind"], under["skip"], after, left)))
        out = out.when((word == "else") & (top["kind"] == "if"), F.concat(below, _frame(top["kind"], F.lit(False), after, nothing)))
        out = out.when((word == "elif") & (top["kind"] == "if") | (word == "else") & (top["kind"] == "for"), F.concat(below, _frame(top["kind"], F.lit(True), after, until(top, at))))
        return out.otherwise(frames)

    start = _frame(F.lit(""), F.lit(False), F.lit(0), nothing).cast(FRAME)
    return F.aggregate(statements, start, step, lambda frames: F.concat(F.flatten(F.transform(but_last(frames, 1), lambda f: f["runs"])), until(F.element_at(frames, -1), F.size(pieces))))


def _unquoted(x: Column) -> Column:
    return F.regexp_replace(x, r"""^['"]|['"]$""", "")


def _call(inside: Column, in_quotes: Column) -> Column:
    """A macro call as SQL: known macros by what they stand for, others by the columns named in them, else NULL."""
    name = F.element_at(F.split(F.regexp_extract(inside, r"^([\w.]+)\s*\(", 1), r"\."), -1)
    between = F.regexp_extract(inside, r"(?s)^[\w.]+\s*\((.*)\)\s*$", 1)
    call = _bound(between, lambda x: F.struct(name.alias("name"), x.alias("between"), F.regexp_extract_all(x, F.lit(ARGUMENT), F.lit(0)).alias("given")))
    texts = lambda x: F.transform(F.filter(x["given"], lambda y: y.rlike(r"""^['"]""")), _unquoted)
    return _bound(call, lambda x: _bound(F.struct(x["name"].alias("name"), x["between"].alias("between"), x["given"].alias("given"), texts(x).alias("texts")), lambda y: _known(y["name"], y["between"], y["given"], y["texts"], in_quotes)))


def _known(name: Column, between: Column, given: Column, texts: Column, in_quotes: Column) -> Column:
    """The call of a macro by its name, what stands between its brackets, the arguments there and those of them that are texts."""
    at = lambda k: _unquoted(F.try_element_at(given, F.lit(k)))
    default = F.try_element_at(given, F.lit(2))
    value = F.when(default.rlike(r"""^['"]"""), F.when(in_quotes, _unquoted(default)).otherwise(F.concat(F.lit("'"), _unquoted(default), F.lit("'"))))
    value = value.when(F.lower(default).isin("none", "null") | default.isNull(), "NULL").when(F.lower(default).isin("true", "false"), F.upper(default)).otherwise(default)
    relations = F.concat(
        F.regexp_extract_all(between, F.lit(r"""\bref\s*\(\s*['"]([^'"]+)"""), F.lit(1)),
        F.transform(F.regexp_extract_all(between, F.lit(r"\bsource\s*\(([^()]*)\)"), F.lit(1)), lambda x: F.regexp_replace(F.regexp_replace(x, r"""['"\s]""", ""), ",", ".")),
    )
    out = F.when(name == "config", "").when(name == "ref", F.try_element_at(texts, F.lit(-1))).when(name == "source", F.array_join(texts, ".")).when(name == "var", value)
    out = out.when(name.isin("surrogate_key", "generate_surrogate_key"), F.when(F.size(texts) > 0, F.concat(F.lit("CONCAT("), F.array_join(texts, ", "), F.lit(")"))).otherwise("NULL"))
    out = out.when(name == "star", "*").when(name == "date_trunc", F.format_string("DATE_TRUNC('%s', %s)", at(1), at(2))).when(name == "safe_cast", F.format_string("CAST(%s AS %s)", at(1), at(2)))
    out = out.when(F.startswith(name, F.lit("current_timestamp")), "CURRENT_TIMESTAMP").when(name == "datediff", F.format_string("DATEDIFF('%s', %s, %s)", at(3), at(1), at(2)))
    out = out.when(name == "dateadd", F.format_string("DATEADD('%s', %s, %s)", at(1), at(2), at(3)))
    for macro, kind in TYPES.items():
        out = out.when(name == macro, kind)
    joined = _bound(relations, lambda x: F.when(F.size(x) > 0, F.array_join(F.transform(x, lambda y: F.concat(F.lit("SELECT * FROM "), y)), "\nUNION ALL\n")).otherwise("NULL"))
    named = F.filter(texts, lambda x: x.rlike(r"^[A-Za-z_][\w.]*$"))
    columns = _bound(named, lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0))).when(F.size(x) > 1, F.concat(F.lit("("), F.array_join(x, " AND "), F.lit(")"))).otherwise("NULL"))
    return out.when(name == "union_relations", joined).otherwise(columns)


_ASSIGNED = r"""(?s)^\{%[-+]?\s*set\s+(\w+)\s*=\s*(['"])([^'"]*)\2\s*[-+]?%\}$"""


def strip_templates(sql: Column) -> Column:
    """Templated SQL made plain.

    References become names, known macros SQL, variables set to a text that text (quoted, unless quotes stand around
    the expression already), other names in quotes themselves, all other expressions NULL; the rest of the markup goes.
    """
    sets = lambda pieces: F.transform(F.filter(pieces, lambda x: x.rlike(_ASSIGNED)), lambda x: F.struct(F.regexp_extract(x, _ASSIGNED, 1).alias("name"), F.regexp_extract(x, _ASSIGNED, 3).alias("text")))

    def expression(text, x):
        inside, in_quotes = x["inside"], x["in_quotes"]
        given = F.try_element_at(F.filter(text["sets"], lambda s: s["name"] == inside), F.lit(-1))["text"]
        name = _bound(given, lambda t: F.when(t.isNotNull(), F.when(in_quotes, t).otherwise(F.concat(F.lit("'"), t, F.lit("'")))).when(in_quotes, inside).otherwise("NULL"))
        return F.when(inside.rlike(r"^[A-Za-z_]\w*$"), name).when(inside.rlike(r"^[\w.]+\s*\("), _call(inside, in_quotes)).otherwise("NULL")

    def render(text, piece, i):
        pieces = text["pieces"]
        before, after = F.right(F.get(pieces, i - 1), F.lit(1)), F.left(F.regexp_replace(F.get(pieces, i + 1), r"^\{#", ""), F.lit(1))
        inside = F.regexp_extract(piece, r"(?s)^\{\{[-+]?\s*(.*?)\s*[-+]?\}\}$", 1)
        read = F.struct(inside.alias("inside"), F.coalesce(before.isin("'", '"') & (before == after), F.lit(False)).alias("in_quotes"))
        return F.when(F.startswith(piece, F.lit("{{")), _bound(read, lambda x: expression(text, x))).when(F.startswith(piece, F.lit("{%")), "").otherwise(F.regexp_replace(piece, r"^\{#", ""))

    text = _bound(_kept_pieces(sql), lambda p: F.struct(p.alias("pieces"), sets(p).alias("sets")))
    return _bound(text, lambda t: F.array_join(F.transform(t["pieces"], lambda x, i: render(t, x, i)), ""))


def referenced_models(sql: Column) -> Column:
    """Names in ref calls of expressions and statements, in order, each once: of several texts in a call the last."""
    markup = F.filter(F.regexp_extract_all(sql, F.lit(PIECE), F.lit(0)), lambda x: F.startswith(x, F.lit("{{")) | F.startswith(x, F.lit("{%")) & ~x.rlike(rf"^{_RAW}"))
    calls = F.flatten(F.transform(markup, lambda x: F.regexp_extract_all(x, F.lit(r"\bref\s*\(([^()]*)\)"), F.lit(1))))
    names = F.transform(calls, lambda x: F.try_element_at(F.filter(F.regexp_extract_all(x, F.lit(ARGUMENT), F.lit(0)), lambda y: y.rlike(r"""^['"]""")), F.lit(-1)))
    return F.array_distinct(F.transform(F.filter(names, lambda x: x.isNotNull()), _unquoted))


def formula_columns(expression: Column) -> Column:
    """Column-like words of a measure formula: quoted texts, function names, numbers and noise words left out."""
    noise = ["and", "or", "not", "case", "when", "then", "else", "end", "null", "in", "is", "as", "distinct", "sum", "count", "avg", "min", "max"]
    plain = F.regexp_replace(F.lower(expression), r"'[^']*'", " ")
    found = F.regexp_extract_all(plain, F.lit(r"\b([a-z_][a-z0-9_.]*)\b(?!\s*\()"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(x) for x in noise]))


def bytes_text(n: Column) -> Column:
    """Bytes in the largest unit that gives at least one."""
    n = n.cast("double")
    out = F.when(n < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(n < 1024 ** (power + 1), F.concat(F.format_number(n / 1024**power, 1), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_number(n / 1024**4, 1), F.lit(" TB")))


def number_text(n: Column) -> Column:
    """A count in thousands, millions or milliards with one digit, without a trailing zero."""
    n = n.cast("double")
    short = lambda power, unit: F.concat(F.regexp_replace(F.format_number(n / 1000**power, 1), r"\.0$", ""), F.lit(unit))
    return F.when(F.abs(n) < 1000, F.format_number(n, 0)).when(F.abs(n) < 1e6, short(1, "K")).when(F.abs(n) < 1e9, short(2, "M")).otherwise(short(3, "B"))


def percent_text(share: Column, digits: int = 1) -> Column:
    """A share as a percentage."""
    return F.concat(F.format_number(100 * share.cast("double"), digits), F.lit("%"))


def duration_text(seconds: Column) -> Column:
    """Milliseconds below a second, seconds below a minute, else minutes and seconds."""
    s = seconds.cast("double")
    minutes = F.floor(s / 60)
    return F.when(s < 1, F.concat(F.round(1000 * s).cast("bigint").cast("string"), F.lit("ms"))).when(s < 60, F.concat(F.format_number(s, 1), F.lit("s"))).otherwise(
        F.concat(minutes.cast("string"), F.lit("m "), F.round(s - 60 * minutes).cast("bigint").cast("string"), F.lit("s"))
    )
