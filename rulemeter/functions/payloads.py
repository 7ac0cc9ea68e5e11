"""Transcriptions: JSON objects in loose text, options as an object or a list, LaTeX as plain mathematics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: labels of options, and commands of LaTeX
LETTERS = ["A", "B", "C", "D", "E"]
LABELS = {"A": "A", "B": "B", "C": "C", "D": "D", "E": "E", "F": "A", "G": "B", "H": "C", "J": "D", "K": "E", "1": "A", "2": "B", "3": "C", "4": "D", "5": "E"}
FENCES = [r"\(", r"\)", r"\[", r"\]", "$$", "$"]
SYMBOLS = [(r"\left", ""), (r"\right", ""), (r"\cdot", "*"), (r"\times", "*"), (r"\div", "/"), (r"\leq", "<="), (r"\le", "<="), (r"\geq", ">="), (r"\ge", ">="), (r"\neq", "!="), (r"\ne", "!="), (r"\pi", "pi")]
KEPT_COMMANDS = ["sin", "cos", "tan", "log", "ln", "abs", "pi", "sqrt", "exp"]
FRAC = r"\\frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}"
LOOSE_ESCAPE = r"""\\(?=[A-Za-z]{2})|\\(?!["\\/bfnrtu])"""
# end of fixed values


def object_text(text: Column) -> Column:
    """What stands from the first brace of a text on, a fence around it left out; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    at = F.locate("{", bare)
    return F.when(at > 0, F.substring(bare, at, F.length(bare)))


def json_object(text: Column) -> Column:
    """The JSON object that a text holds first, as text of its own; what follows it is not read. Null if there is none.

    If it does not parse, backslashes that begin a LaTeX command or no escape of JSON are doubled, and it is tried again. An
    object that names a key twice does not parse unless the session allows it (spark.sql.variant.allowDuplicateKeys)."""
    body = object_text(text)
    fixed = F.regexp_replace(body, LOOSE_ESCAPE, r"\\\\")
    is_object = lambda s: F.try_parse_json(s).isNotNull()
    return F.when(is_object(body), body).when(is_object(fixed), fixed)


def option_letter(label: Column) -> Column:
    """A to E for a label such as (b), 2 or g; null for others."""
    bare = F.upper(F.trim(F.btrim(F.trim(label), F.lit("()"))))
    return F.element_at(F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair)), bare)


def _first(pairs: Column) -> Column:
    """The map of (letter, text) pairs, the first of each letter, without null letters and blank texts."""
    good = F.filter(pairs, lambda p: p["letter"].isNotNull() & (F.trim(p["text"]) != ""))
    names = F.transform(good, lambda p: p["letter"])
    return F.map_from_entries(F.filter(good, lambda p, i: F.array_position(names, p["letter"]) == i + 1))


def options(payload: Column) -> Column:
    """Map of letter to text of a payload's ``options`` (json_object), be they an object of labels or a list of texts or of
    objects; of labels that mean one letter the first counts. Others give an empty map; a null payload null."""
    raw = F.from_json(payload, "struct<options:string>")["options"]
    kind = F.substring(F.ltrim(raw), 1, 1)
    pair = lambda letter, text: F.struct(letter.alias("letter"), F.coalesce(text, F.lit("")).alias("text"))
    entries = F.map_entries(F.from_json(raw, "map<string,string>"))
    named = F.transform(entries, lambda e: pair(option_letter(e["key"]), e["value"]))
    # a list's items are texts or objects; an object's fields are read only if it is one
    items = F.slice(F.from_json(raw, "array<string>"), 1, len(LETTERS))
    own = lambda i: F.element_at(F.array(*map(F.lit, LETTERS)), i + 1)
    field = lambda o, *names: F.coalesce(*(F.nullif(o[n], F.lit("")) for n in names))

    def listed(x: Column, i: Column) -> Column:
        o = F.from_json(x, "struct<label:string,key:string,text:string,content:string,value:string>")
        inside = F.ltrim(x).startswith("{") & F.try_parse_json(x).isNotNull()
        return F.when(inside, pair(F.coalesce(option_letter(field(o, "label", "key")), own(i)), field(o, "text", "content", "value"))).otherwise(pair(own(i), x))

    empty = F.create_map().cast("map<string,string>")
    return F.when(payload.isNotNull(), F.coalesce(F.when(kind == "{", _first(named)).when(kind == "[", _first(F.transform(items, listed))), empty))


def latex_to_ascii(latex: Column) -> Column:
    """LaTeX as plain mathematics: fractions from the inside out until none is left, roots, powers, relations; other commands go."""
    t = F.trim(latex)
    for mark, to in [(f, "") for f in FENCES] + SYMBOLS:
        t = F.replace(t, F.lit(mark), F.lit(to))
    # each pass rewrites the innermost fractions, so there are no more passes than fractions
    t = F.aggregate(F.sequence(F.lit(1), F.regexp_count(t, F.lit(r"\\frac")) + 1), t, lambda s, _: F.regexp_replace(s, FRAC, "($1)/($2)"))
    for pattern, to in [(r"\\sqrt\s*\{([^{}]+)\}", "sqrt($1)"), (r"\\sqrt\s*([A-Za-z0-9]+)", "sqrt($1)"), (r"\^\{([^{}]+)\}", "**($1)"), (r"\^([A-Za-z0-9]+)", "**$1"), (rf"\\({'|'.join(KEPT_COMMANDS)})(?![A-Za-z])", "$1"), (r"\\[A-Za-z]+", " ")]:
        t = F.regexp_replace(t, pattern, to)
    return F.trim(F.regexp_replace(F.translate(t, "{}", "()"), r"\s+", " "))


def equation_texts(payload: Column) -> Column:
    """The texts of a payload's ``equations``, in order: its strings, and of its objects ``ascii`` or else ``latex`` rewritten."""
    raw = F.from_json(payload, "struct<equations:string>")["equations"]
    kind = F.substring(F.ltrim(raw), 1, 1)
    items = F.when(kind == "[", F.from_json(raw, "array<string>")).when(kind == "{", F.array(raw)).otherwise(F.array().cast("array<string>"))

    def one(x: Column) -> Column:
        o = F.from_json(x, "struct<ascii:string,latex:string>")
        inside = F.ltrim(x).startswith("{") & F.try_parse_json(x).isNotNull()
        return F.when(inside, F.coalesce(F.nullif(F.trim(o["ascii"]), F.lit("")), latex_to_ascii(F.coalesce(o["latex"], F.lit(""))))).otherwise(x)

    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), one), lambda s: s != "")
