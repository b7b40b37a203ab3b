"""Text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that a default CSV reader takes as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def strip(c: Column) -> Column:
    """Remove all leading and trailing white space; `trim` alone takes only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(NA_TOKENS), c)


def vehicle_type(c: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(strip(c)), F.lit("NULL")), F.lit("UNKNOWN"))


def junction(c: Column) -> Column:
    text = strip(c)
    return F.when(text.isNull() | text.isin("NULL", ""), "No Junction").otherwise(text)


def station(c: Column) -> Column:
    return F.coalesce(F.nullif(strip(c), F.lit("NULL")), F.lit("Unknown"))


def strict_vehicle_type(c: Column) -> Column:
    text = F.upper(strip(c))
    return F.when(text.isNull() | text.isin("NULL", ""), "UNKNOWN").otherwise(text)


def strict_junction(c: Column) -> Column:
    text = strip(c)
    missing = text.isNull() | F.upper(text).isin("NULL", "")
    return F.when(missing, "No Junction").otherwise(text)


def strict_station(c: Column) -> Column:
    text = strip(c)
    return F.when(text.isNull() | (text == ""), "Unknown").otherwise(text)


def _once(value: Column, body) -> Column:
    """Binds a value that `body` uses several times, so it is computed once per row."""
    return F.transform(F.array(value), body)[0]


# A token of a flat literal: a string, None, True, False, a whole number, or a mark.
TOKEN = (
    r"""(?s)'(?:[^'\\\n]++|\\.)*+'|"(?:[^"\\\n]++|\\.)*+"|(?:None|True|False)(?!\w)"""
    r"""|[-+]?(?:0|[1-9][0-9]*)(?![\w.])|[\[\](),]"""
)
MOST_ESCAPES = 1_000  # in one text; the regular expression recurses for each
HELD = "\x01"  # stands for an escaped backslash meanwhile


def _unescaped(token: Column) -> Column:
    """What a quoted token holds, or null if it has other escapes than those of quotes, the
    backslash, line feed, carriage return and tab."""
    body = F.replace(F.substring(token, F.lit(2), F.length(token) - 2), F.lit("\\\\"), F.lit(HELD))
    text = body
    for escape, character in (("\\'", "'"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), (HELD, "\\")):
        text = F.replace(text, F.lit(escape), F.lit(character))
    other = F.contains(token, F.lit(HELD)) | F.rlike(body, F.lit(r"""(?s)\\[^'"nrt]"""))
    return F.when(~other, text)


def _shown(text: Column) -> Column:
    """A string the way a tuple shows it."""
    body = text
    for character, escape in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(character), F.lit(escape))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(single)


def _fold(state: Column, token: Column) -> Column:
    """One token more. State: whether all is well so far; the kind of container, `` for none and
    `,` for a tuple without brackets; whether its bracket closed; its members as text and as
    shown; and the member that is being read, which adjacent strings make longer."""
    kind, closed, text, shown = state["kind"], state["closed"], state["text"], state["shown"]
    quoted = F.substring(token, 1, 1).isin("'", '"')
    string = _unescaped(token)
    number = F.regexp_replace(F.regexp_replace(token, r"^\+|^-(?=0$)", ""), "^$", "0")
    mark = token.isin("[", "(", "]", ")", ",")
    opens, ends = token.isin("[", "("), token.isin("]", ")")
    begins = (kind == "") & text.isNull()
    fits = (
        F.when(closed, False)
        .when(opens, begins)
        .when(token == ",", text.isNotNull())
        .when(ends, ((token == "]") & (kind == "[")) | ((token == ")") & (kind == "(")))
        .when(quoted, string.isNotNull() & (text.isNull() | state["string"]))
        .otherwise(text.isNull())
    )
    done = (token == ",") | ends
    full = done & text.isNotNull()
    longer = F.when(text.isNull(), string).otherwise(F.concat(text, string))
    return F.struct(
        (state["ok"] & F.coalesce(fits, F.lit(False))).alias("ok"),
        F.when(opens, token).when((token == ",") & (kind == ""), ",").otherwise(kind).alias("kind"),
        (closed | ends).alias("closed"),
        (state["commas"] + (token == ",").cast("int")).alias("commas"),
        F.when(full, F.concat(state["texts"], F.array(text))).otherwise(state["texts"]).alias("texts"),
        F.when(full, F.concat(state["showns"], F.array(shown))).otherwise(state["showns"]).alias("showns"),
        F.when(~mark, F.when(quoted, longer).otherwise(number)).when(~done, text).alias("text"),
        F.when(~mark, F.when(quoted, _shown(longer)).otherwise(number)).when(~done, shown).alias("shown"),
        F.when(~mark, quoted).otherwise(state["string"]).alias("string"),
    )


def _members(state: Column) -> Column:
    """The texts of a list, or the one text of anything else; null for what is no literal."""
    kind, text = state["kind"], state["text"]
    bare = F.when(text.isNull(), state["showns"]).otherwise(F.concat(state["showns"], F.array(state["shown"])))
    showns = F.when(kind == ",", bare).otherwise(state["showns"])
    inside = F.concat(F.array_join(showns, ", "), F.when(F.size(showns) == 1, ",").otherwise(""))
    whole = state["ok"] & F.when(kind.isin("[", "("), state["closed"]).otherwise(True)
    return (
        F.when(~whole, None)
        .when(kind == "", F.when(text.isNotNull(), F.array(text)))
        .when(kind == "[", F.when(F.size(state["texts"]) == 0, F.array(F.lit("[]"))).otherwise(state["texts"]))
        .when((kind == "(") & (state["commas"] == 0) & (F.size(state["texts"]) == 1), state["texts"])
        .otherwise(F.array(F.concat(F.lit("("), F.when(F.size(showns) == 0, "").otherwise(inside), F.lit(")"))))
    )


def _literal(text: Column) -> Column:
    """Members of a flat literal (see `violation_array`), or null."""
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    start = F.struct(
        F.lit(True).alias("ok"), F.lit("").alias("kind"), F.lit(False).alias("closed"), F.lit(0).alias("commas"),
        empty.alias("texts"), empty.alias("showns"), none.alias("text"), none.alias("shown"), F.lit(False).alias("string"),
    )
    whole = F.trim(F.regexp_replace(F.regexp_replace(text, TOKEN, ""), r"[ \t\r\n\f]+", "")) == ""
    few = F.length(F.regexp_replace(text, r"[^\\]+", "")) <= MOST_ESCAPES
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    can_be = F.rlike(text, F.lit(r"""^[\['"(+\-0-9NTF]""")) & few
    return F.when(can_be, F.when(whole, F.aggregate(tokens, start, _fold, _members)))


def _items(text: Column) -> Column:
    parsed = F.from_json(text, "array<string>")
    return _once(parsed, lambda items: _listed_or_single(items, text))


def _listed_or_single(items: Column, text: Column) -> Column:
    is_list = F.size(F.coalesce(items, F.array())) > 0
    inner = (F.locate("[", text, 2) > 0) | F.contains(text, F.lit("{"))
    whole = is_list & ~inner & ~F.exists(items, lambda v: v.isNull())
    read = F.when(whole, items).otherwise(F.coalesce(_literal(text), F.array(text)))
    return F.transform(read, lambda v: F.upper(strip(v)))


def violation_array(c: Column) -> Column:
    """Listed offences, upper-cased; a text that is no list becomes the one item it holds.

    Besides JSON lists, flat literals are read: strings in either quotes, adjacent ones joined,
    None, True, False and whole numbers, alone, in lists or in tuples, with or without brackets
    and a last comma. A tuple is one item, shown as such. What else a literal may hold (inner
    containers, fractions, prefixes, other escapes) leaves the text as it is."""
    return _once(
        strip(c),
        lambda text: F.when(
            F.upper(F.coalesce(text, F.lit(""))).isin("", "NULL"), F.array(F.lit("UNKNOWN"))
        ).otherwise(_items(text)),
    )


def violation_array_from_list(c: Column) -> Column:
    """The same for a source that already delivers an array; an empty one means UNKNOWN."""
    items = F.transform(c, lambda v: F.coalesce(F.upper(strip(v)), F.lit("NONE")))
    return F.when(c.isNull() | (F.size(c) == 0), F.array(F.lit("UNKNOWN"))).otherwise(items)


def violation_text(c: Column) -> Column:
    return F.array_join(violation_array(c), ", ")


def station_key(c: Column) -> Column:
    """Folder-safe key; names that differ only in punctuation share one key on purpose."""
    key = F.regexp_replace(c, r"[^\p{L}\p{N}]", "_")
    return F.when(key.isNull() | (key == ""), "unknown").otherwise(key)
