"""Text column functions: folding, names, descriptions, shares, routes.

All functions take a column (or its name) and return a column built from JVM
expressions, so they stay inside whole-stage code generation.
"""

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c) -> Column:
    """Single spaces, no outer spaces."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def _any(words) -> str:
    """Alternation of literal words, in the given order."""
    special = "\\.+*?()[]{}|^$"
    esc = ["".join("\\" + ch if ch in special else ch for ch in w) for w in words]
    return "(?:" + "|".join(esc) + ")"


@cache
def _accent_table() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one ASCII character.

    Spark SQL has no normalisation function, so the table is generated once
    from the Unicode data of the running Python.
    """
    src, dst = [], []
    for code in range(0x80, 0x10000):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF or ch in V.CYRILLIC_ONE or ch in V.CYRILLIC_LONG:
            continue
        plain = "".join(p for p in unicodedata.normalize("NFKD", ch) if ord(p) < 128)
        if len(plain) == 1:
            src.append(ch)
            dst.append(plain)
    for ch, plain in V.CYRILLIC_ONE.items():
        src.append(ch)
        dst.append(plain)
    return "".join(src), "".join(dst)


def ascii_fold(c) -> Column:
    """Upper-case letters of any supported script to ASCII; the rest is dropped.

    The input is expected in upper case (see `fold`)."""
    x = col(c)
    for long, latin in V.CYRILLIC_LONG.items():
        x = F.replace(x, F.lit(long), F.lit(latin))
    src, dst = _accent_table()
    x = F.translate(x, src, dst)
    return F.regexp_replace(x, r"[^\x00-\x7F]", "")


def fold(c) -> Column:
    """Upper case and ASCII, all four Turkish i letters to I.

    Plain ASCII rows skip the letter tables."""
    x = F.coalesce(col(c).cast("string"), F.lit(""))
    up = F.upper(F.replace(F.replace(x, F.lit("ı"), F.lit("I")), F.lit("İ"), F.lit("I")))
    return F.when(x.rlike(r"[^\x00-\x7F]"), ascii_fold(up)).otherwise(F.upper(x))


def name_norm(c) -> Column:
    """Canonical name, letters and single spaces only."""
    return F.trim(F.regexp_replace(fold(c), r"[^A-Z]+", " "))


def tokens(norm) -> Column:
    """Sorted distinct words of a canonical name."""
    n = col(norm)
    return F.sort_array(F.array_remove(F.array_distinct(F.split(n, " ")), ""))


def token_key(norm) -> Column:
    """The token set as one string, usable as an equi-join key."""
    return F.array_join(tokens(norm), " ")


def letter_sig(norm) -> Column:
    """Sorted letters of a canonical name; ignores order and spacing."""
    n = col(norm)
    # Each letter as often as it occurs: nothing has to be sorted.
    times = lambda a: F.length(n) - F.length(F.replace(n, F.lit(a), F.lit("")))
    return F.concat(*[F.repeat(F.lit(a), times(a)) for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"])


def clean_person(c) -> Column:
    """Strip everything but the person from a description."""
    cities = _any(V.CITY_NAMES)
    hotel = r"\b" + _any(V.HOTEL_WORDS) + r"\b"
    x = fold(c)
    for pattern in (
        r"\\\s*[MF]\b",                                   # gender mark
        r"\[[^\]]*\]",                                    # stay dates
        r"\([^)]*\)",                                     # remarks
        r"\b[A-Z]{2}\d{5,}\b",                            # ticket number
        r"\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b",             # dates
        r"\b\d+\s*/\s*\d+\b",                             # fractions
        r"[/\\]",
        r"[,;:.]+",
        r"\b[A-Z]{3}(?:\s*-\s*[A-Z]{3})+\b",              # airport chain
        r"\b" + cities + r"\s*-\s*" + cities + r"\b",     # city pair
        r"-",
    ):
        x = F.regexp_replace(x, pattern, " ")
    x = squeeze(x)
    x = squeeze(F.regexp_replace(x, r"\b" + _any(V.NOISE_PHRASES) + r"\b", " "))
    # The hotel follows the person; a leading hotel word cuts nothing.
    x = F.regexp_replace(x, r"^(?!" + hotel + r")(.+?)" + hotel + r".*$", "$1")
    x = F.regexp_replace(F.regexp_replace(x, r"\b\d+\b", " "), r"[^A-Z ]+", " ")
    words = F.filter(F.split(x, r"\s+"), lambda t: F.length(t) >= 2)
    return F.array_join(words, " ")


def trim_tail(c) -> Column:
    """Cut a cleaned name at the first service word.

    A word with a glued service tail keeps its head and ends the name; the
    context word ends it only after two name words and before a fee word."""
    service = r"(?:" + _any(V.SERVICE_WORDS) + r")(?= |$)"
    context = V.CONTEXT_WORD + r" " + _any(V.CONTEXT_FOLLOWERS) + r"(?= |$)"
    head = r"(?!" + service + r")"
    # Up to two words freely, later words only while they do not open the fee context.
    free = head + r"[A-Z]+"
    late = r"(?!" + context + r")" + head + r"[A-Z]+"
    x = squeeze(c)
    kept = F.regexp_extract(x, rf"^({free}(?: {free}(?: {late})*)?)?", 1)
    # The first glued tail ends the name. A tail that follows another one closely is left.
    glued = rf"^((?:[A-Z]+ )*?[A-Z]{{3,}}?){_any(V.GLUED_TAILS)}(?: .*)?$"
    return F.regexp_replace(kept, glued, "$1")


def valid_person(c) -> Column:
    """At least two words of two or more letters, five letters together."""
    x = col(c)
    words = F.split(x, " ")
    return (
        (F.size(words) >= 2)
        & F.forall(words, lambda w: (F.length(w) >= 2) & ~w.isin(*V.SERVICE_WORDS))
        & (F.length(F.replace(x, F.lit(" "), F.lit(""))) >= 5)
    )


def _cut_before(text, *patterns) -> Column:
    """Text before the earliest match that is not at the start."""
    x = col(text)
    ends = [F.length(x)]
    for p in patterns:
        at = F.regexp_instr(x, F.lit(p))
        ends.append(F.when(at > 1, at - 1).otherwise(F.length(x)))
    return F.left(x, F.least(*ends))


_DATE = r"\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b"


def persons_of(category, description) -> Column:
    """Array of persons in a description, by expense category.

    The category decides which part of the text may hold a name; the parts are
    then cleaned by one rule."""
    cat, x = col(category), fold(description)
    t = F.trim(x)
    # Ticket: after the ticket number, up to the passenger mark, title or route.
    ticket = _cut_before(
        F.regexp_replace(x, r"^\s*[A-Z]{2}\s*\d{6,}\s+(?=.)", ""),
        r"\\\s*[A-Z]\b", r"\s+(?:MR|MRS|MS|MSTR|MISS|CHD|INF)\b",
        r"\b[A-Z]{3}(?:\s*-\s*[A-Z]{3})+\b")
    # Hotel: several guests before the stay dates.
    stay = F.when(F.instr(x, "[") > 1, F.substring_index(x, "[", 1)).otherwise(_cut_before(x, _DATE))
    # Baggage: the name stands inside the service text.
    inside = F.regexp_extract(
        x, r"(?s)EKSTRA\s+BAGAJ(?:\s+UCRETI)?\s+(.+?)\s*TARAFINDAN", 1)
    # Other services: nothing when the text opens with a date block.
    other = F.when(~t.startswith("["), _cut_before(t, r"\[", r">", _DATE)).otherwise("")
    parts = (
        F.when(cat == "Otel", F.split(stay, r"[;&+]|\s/\s"))
        .when(cat == "Bilet", F.array(ticket))
        .when(cat == "Vize", F.array(x))
        .when(cat == "Bagaj", F.array(inside, x))
        .otherwise(F.array(other))
    )
    named = F.transform(parts, lambda p: F.struct(
        F.trim(p).alias("part"), trim_tail(clean_person(p)).alias("name")))
    named = F.filter(named, lambda n: valid_person(n["name"]))
    hotel = r"\b" + _any(V.HOTEL_WORDS) + r"\b"

    def guest(n):
        # A hotel name without a known hotel word leaves a long tail: keep three words.
        words = F.split(n["name"], " ")
        long = ~n["part"].rlike(rf"^(?!{hotel}).+?{hotel}") & (F.size(words) > 4)
        return F.when((cat == "Otel") & long, F.array_join(F.slice(words, 1, 3), " ")).otherwise(n["name"])

    names = F.array_distinct(F.transform(named, guest))
    return F.when(cat == "Otel", names).otherwise(F.slice(names, 1, 1))


def category_of(operation, description) -> Column:
    """Expense category from the operation label, then from the text."""
    x = fold(description)
    op = F.lower(squeeze(fold(operation)))
    known = F.lit(None).cast("string")
    for label, cat in V.OPERATION_CATEGORY.items():
        known = F.when(op == label, cat).otherwise(known)
    return (
        F.when(x.contains("EKSTRA BAGAJ") | x.contains("BAGAJ UCRETI"), "Bagaj")
        .when(known.isNotNull(), known)
        .when(x.contains("KONAKLAMA"), "Otel")
        .when(x.contains("VIZE"), "Vize")
        .when(x.contains("BILET"), "Bilet")
        .otherwise(V.DEFAULT_CATEGORY)
    )


def category_hint(*texts) -> Column:
    """Category from a file or sheet name of a generic feed."""
    joined = column_key(F.concat_ws(" ", *[col(t) for t in texts]))
    out = F.lit(V.DEFAULT_CATEGORY)
    for word, cat in reversed(V.CATEGORY_HINTS):
        out = F.when(joined.contains(word), cat).otherwise(out)
    return out


_ROUTE = r"\b([A-Z]{3}(?:\s*-\s*[A-Z]{3})+)\b"


def route(c) -> Column:
    """Airports of the first route in a description, in order."""
    chain = F.regexp_extract(F.upper(F.coalesce(col(c), F.lit(""))), _ROUTE, 1)
    return F.when(chain != "", F.split(chain, r"\s*-\s*"))


def direction(stops) -> Column:
    """In, out, round or none, from the first and last stop."""
    s = col(stops)
    first, last = F.get(s, 0), F.element_at(s, -1)

    def area(code):
        return (F.when(code.isin(*V.HOME_AIRPORTS), "H").when(code.isin(*V.SITE_AIRPORTS), "S"))

    a, b = area(first), area(last)
    return (
        F.when(a.isNull() | b.isNull(), "none")
        .when(a == b, "round")
        .when((a == "H") & (b == "S"), "in")
        .otherwise("out")
    )


def site_key(c) -> Column:
    """Comparison key of a site, centre or company label.

    Dashes become spaces before folding, otherwise the long ones vanish."""
    x = F.translate(F.coalesce(col(c).cast("string"), F.lit("")), V.DASHES, " " * len(V.DASHES))
    return squeeze(F.translate(fold(x), "().,&", "     "))


def company_of(c, table=None) -> Column:
    """Canonical company of a label, null when it is not known."""
    table = V.CANONICAL_COMPANY if table is None else table
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.element_at(F.create_map(*pairs), site_key(c))


def _entity_pattern(entities) -> str:
    names = sorted(entities, key=lambda e: (-len(e.split(" ")), e))
    one = _any(names)
    return rf"^{one}(?: {one})*$"


def is_entity(c, entities=V.ENTITY_LABELS) -> Column:
    """The label's words are covered end to end by entity names."""
    key = site_key(c)
    words = F.filter(F.split(F.replace(key, F.lit("+"), F.lit(" ")), " "),
                     lambda w: w.rlike("^[A-Z]+$"))
    return (key != "") & (key.isin(*entities) | F.array_join(words, " ").rlike(_entity_pattern(entities)))


def parse_shares(*texts, entities=None) -> Column:
    """`LABEL n/d` shares as array of (label, num, den).

    Dates and times are excluded by the surroundings of the fraction; a label
    must be covered by known entity names."""
    known = tuple(dict.fromkeys(tuple(V.ENTITY_LABELS) + tuple(V.CANONICAL_COMPANY))) \
        if entities is None else tuple(entities)
    pattern = (r"(?<![\d/])([A-Z][A-Z0-9]*(?:\s+[A-Z0-9]+)*?)\s*(\d{1,2})\s*/\s*(\d{1,2})"
               r"(?!\s*[/:.]\s*\d)(?!\d)")
    found = []
    for t in texts:
        x = fold(t)
        groups = [F.regexp_extract_all(x, F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
        found.append(F.zip_with(F.arrays_zip(groups[0].alias("a"), groups[1].alias("b")), groups[2],
                                lambda ab, d: F.struct(ab["a"].alias("raw"),
                                                       ab["b"].cast("int").alias("num"),
                                                       d.cast("int").alias("den"))))
    shares = F.concat(*found)

    def label(s):
        cut = trim_tail(squeeze(s["raw"]))
        return F.when(cut == "", squeeze(s["raw"])).otherwise(cut)

    shares = F.transform(shares, lambda s: F.struct(
        label(s).alias("label"), s["num"].alias("num"), s["den"].alias("den")))
    return F.filter(shares, lambda s: (
        (s["num"] >= 1) & (s["num"] <= s["den"]) & (s["den"] >= 2)
        & (s["den"] <= V.MAX_SHARE_DENOMINATOR) & is_entity(s["label"], known)))


def status_norm(c) -> Column:
    """One spelling for left and for active staff."""
    text = F.nullif(F.trim(col(c).cast("string")), F.lit(""))
    x = fold(text)
    return F.when(x.startswith("CIKIS"), "Cikis").when(x.startswith("AKTIF"), "Aktif").otherwise(text)


def masculine(norm) -> Column:
    """Masculine form of a feminine surname, else null."""
    t = col(norm)
    out = F.lit(None).cast("string")
    for end, new in reversed(V.FEMININE_ENDINGS):
        out = F.when(t.endswith(end) & (F.length(t) - len(end) >= 3),
                     F.concat(F.left(t, F.length(t) - len(end)), F.lit(new))).otherwise(out)
    return F.when((F.length(t) >= V.FEMININE_MIN) & ~t.contains(" "), out)


def mask_id(c) -> Column:
    """First three characters, stars for the rest."""
    x = F.trim(F.coalesce(col(c), F.lit("")))
    return F.when(x == "", "?").otherwise(
        F.rpad(F.left(x, F.lit(3)), F.length(x), F.lit("*")))


def currency_key(c) -> Column:
    """Trimmed upper-case currency, `?` when missing."""
    x = F.upper(F.trim(F.coalesce(col(c), F.lit(""))))
    return F.when(x == "", "?").otherwise(x)


def source_name(source_file, label=None) -> Column:
    """The feed a line belongs to: its own label, else the text after the last `> `."""
    x = F.trim(F.element_at(F.split(F.coalesce(col(source_file), F.lit("")), "> "), -1))
    x = F.when(x == "", "(unknown)").otherwise(x)
    return x if label is None else F.coalesce(F.nullif(col(label), F.lit("")), x)


def column_key(c) -> Column:
    """H2: comparison key of a header or sheet name: lower, ASCII, single spaces."""
    x = F.translate(F.coalesce(col(c).cast("string"), F.lit("")),
                    " \n\r\t_/-.(),;:", " " * 14)
    return F.lower(squeeze(fold(x)))
