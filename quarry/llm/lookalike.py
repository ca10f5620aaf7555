"""One form for texts that look the same but differ in their characters (problem 8)."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.session import shared_folder

#: Letters that look like the Latin letter beside them in common typefaces; used where there is no session
#: to ask for the whole public table (:func:`look_alikes`).
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԍ": "G", "Ү": "Y", "ү": "y", "Ӏ": "I",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ϳ": "j",
    "օ": "o", "ɡ": "g", "‐": "-",
}
#: Kinds of compatibility forms that look like what they stand for. Raised, lowered, circled, squared and
#: fraction forms look different and are left alone.
ALIKE_FORMS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Forms of these kinds that a reader tells apart from what they stand for.
DIFFERENT_FORMS = "ſϐϑϒϕϖϰϱϲϴϵϹ‗․‥…"
#: Characters without any mark on the page: soft hyphen, joiners, directions, word joiner, invisible
#: operators, variation selectors, byte order mark, tags.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0001}-\x{E01EF}]"
#: Pictographs; a joiner after one makes another picture and is kept (as a private character).
_PICTURE = r"[\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{1F000}-\x{1FAFF}]"
_JOINED = "\ue000"


#: Latin letters of the public table that a reader doesn't tell from the plain one. The others, as the
#: dotless i, are letters of their own in some alphabet.
LATIN_ALIKE = {"ɡ": "g", "ɑ": "a"}
_TABLES: dict[int, tuple[tuple[str, str], ...]] = {}


def look_alikes(spark: SparkSession) -> tuple[tuple[str, str], ...]:
    """Letters of other scripts and the Latin letter each looks like, by rule from the public table of confusable characters.

    The table is the one of the ICU library that Spark brings: a letter whose skeleton is that of a plain Latin letter
    looks like it, a capital like the capital. Where several letters of a script and case would become one, only those
    count whose capital becomes the capital too, as the script's readers tell its letters apart.
    """
    key = id(spark.sparkContext._jvm)
    if key not in _TABLES:
        checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        letters = [c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c)[0] == "L" and not unicodedata.decomposition(c) and unicodedata.name(c, "").split(" ")[0] not in ("", "LATIN", "CJK", "HANGUL", "TANGUT")]
        skeletons = checker.getSkeleton(0, "\n".join(letters)).split("\n")
        found = {c: "I" if s == "l" and unicodedata.category(c) == "Lu" else s for c, s in zip(letters, skeletons) if len(s) == 1 and s.isascii() and s.isalpha()}
        kinds = Counter((unicodedata.name(c).split(" ")[0], unicodedata.category(c), to) for c, to in found.items())
        kept = {c: to for c, to in found.items() if kinds[unicodedata.name(c).split(" ")[0], unicodedata.category(c), to] == 1 or found.get(c.upper()) == to.upper()}
        _TABLES[key] = tuple(sorted({**kept, **LATIN_ALIKE, "‐": "-"}.items()))
    return _TABLES[key]


def single_forms(alike: tuple[tuple[str, str], ...] | None = None) -> tuple[str, str]:
    """Characters and what each becomes, by rule from the character database and a table of look-alikes."""
    known = dict(LOOK_ALIKES if alike is None else alike)
    pairs: dict[str, str] = {}
    for code in range(0x80, 0x110000):
        c = chr(code)
        tag, _, rest = unicodedata.decomposition(c).partition(" ")
        if tag in ALIKE_FORMS and c not in DIFFERENT_FORMS and " " not in rest:
            to = unicodedata.normalize("NFKC", c)
            if len(to) == 1 and to not in "\u115f\u1160":  # fillers are invisible and go before
                pairs[c] = known.get(to, to)
    pairs.update(known)
    for code in range(0xC0, 0x3000):  # accented look-alikes
        c = chr(code)
        first, *marks = unicodedata.normalize("NFD", c)
        if marks and first in known:
            to = unicodedata.normalize("NFC", known[first] + "".join(marks))
            if len(to) == 1:
                pairs[c] = to
    return "".join(pairs), "".join(pairs.values())


def several_forms() -> dict[str, str]:
    """Ligatures and roman numerals of several letters that look like those letters."""
    codes = [*range(0xFB00, 0xFB05), 0xFB06, *range(0x2160, 0x2180), 0x132, 0x133, 0x1C4, 0x1C5, 0x1C6, *range(0x1C7, 0x1CD), *range(0x1F1, 0x1F4), 0x203C, 0x2047, 0x2048, 0x2049]
    out = {}
    for code in codes:
        to = unicodedata.normalize("NFKC", chr(code))
        if len(to) > 1:
            out[chr(code)] = to
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@lru_cache
def canonical_sql(column: str = "text", alike: tuple[tuple[str, str], ...] | None = None) -> str:
    """The DuckDB expression of the one form.

    Steps: line ends to LF; pictures' joiners kept, other invisible characters dropped; composed (NFC); ligatures spelt
    out; spaces of any width, compatibility forms and look-alikes replaced; composed again. Texts of plain ASCII only
    get their line ends changed. Null stays null, an empty text stays empty.
    """
    ends = rf"regexp_replace({column}, '\r\n?|[\x{{0085}}\x{{2028}}]', chr(10), 'g')"
    shown = ends
    for _ in range(2):  # twice, as matches don't overlap
        shown = rf"regexp_replace({shown}, '({_PICTURE}[\x{{FE0F}}\x{{1F3FB}}-\x{{1F3FF}}]*)\x{{200D}}({_PICTURE})', '\1{_JOINED}\2', 'g')"
    shown = f"nfc_normalize(regexp_replace({shown}, '{INVISIBLE}+', '', 'g'))"
    several = several_forms()
    spelt = "x"
    for form, to in several.items():
        spelt = f"replace({spelt}, {_quoted(form)}, {_quoted(to)})"
    spelt = f"CASE WHEN regexp_matches(x, '[{''.join(several)}]') THEN {spelt} ELSE x END"
    source, target = single_forms(alike)
    rare = "".join(c for c in source if c not in LOOK_ALIKES)  # the frequent ones are replaced without a search before
    few = {c: t for c, t in zip(source, target) if c not in rare}
    ranges = _ranges(rare)
    wide = f"CASE WHEN regexp_matches(y, '[{ranges}]') THEN translate(y, {_quoted(rare)}, {_quoted(''.join(t for c, t in zip(source, target) if c in set(rare)))}) ELSE y END"
    alike = f"nfc_normalize(translate({wide}, {_quoted(''.join(few))}, {_quoted(''.join(few.values()))}))"
    inner = f"list_transform([list_transform([{shown}], lambda x: {spelt})[1]], lambda y: {alike})[1]"
    return f"CASE WHEN regexp_matches({column}, '[^\\x00-\\x7F]') THEN {inner} ELSE regexp_replace({column}, '\\r\\n?', chr(10), 'g') END"


def _ranges(chars: str) -> str:
    """A character class for ``chars``, with runs as ranges."""
    codes = sorted({ord(c) for c in chars})
    out, start = [], 0
    for i in range(1, len(codes) + 1):
        if i == len(codes) or codes[i] != codes[i - 1] + 1:
            out.append(rf"\x{{{codes[start]:X}}}-\x{{{codes[i - 1]:X}}}")
            start = i
    return "".join(out)


_CONNECTIONS: dict[str, object] = {}


def _database():
    """One DuckDB connection a worker, on one thread, with no file."""
    if "it" not in _CONNECTIONS:
        import duckdb

        _CONNECTIONS["it"] = duckdb.connect(config={"threads": 1, "memory_limit": "1GB"})
    return _CONNECTIONS["it"]


def with_canonical(df: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """``key, canonical`` (or ``key, canonical_hash, text_hash, blank`` without the texts), by SQL inside each Arrow batch.

    Null texts give null. Every row is kept, repeats too. Hashes are SHA-256 of the UTF-8 bytes.
    """
    kind = df.schema[key].dataType.simpleString()
    form = canonical_sql("_text", look_alikes(df.sparkSession))
    if keep_text:
        query, schema = f"SELECT _key, {form} AS canonical FROM batch", f"_key {kind}, canonical string"
    else:
        query = rf"SELECT _key, sha256(c) AS canonical_hash, sha256(_text) AS text_hash, NOT regexp_matches(c, '\S') AS blank FROM (SELECT _key, _text, {form} AS c FROM batch)"
        schema = f"_key {kind}, canonical_hash string, text_hash string, blank boolean"

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        database = _database()
        for part in batches:
            database.register("batch", pa.Table.from_batches([part]))
            result = database.sql(query).to_arrow_table()
            yield from result.combine_chunks().to_batches()
            database.unregister("batch")

    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(normalise, schema).withColumnRenamed("_key", key)


def lookalike_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, class_id, spelling_id``: the rows whose texts look like another text with other characters.

    A class is a look, named by its lowest key; a spelling is one string of it, named by the lowest key that has it.
    Null, empty and blank texts are in no class, nor are rows without a key. Only hashes are shuffled; looks with one
    spelling are dropped by an aggregation, so copies of one text never meet.
    """
    seen = with_canonical(df, key, text, keep_text=False).filter(F.col(key).isNotNull() & ~F.col("blank")).select(key, F.unhex("canonical_hash").alias("look"), F.unhex("text_hash").alias("spelling"))
    shared_folder(df.sparkSession)
    seen = seen.checkpoint()  # hashes only; read twice below
    spellings = seen.groupBy("look", "spelling").agg(F.min(key).alias("spelling_id"))
    looks = spellings.groupBy("look").agg(F.min("spelling_id").alias("class_id"), F.count("*").alias("n")).filter("n > 1").select("look", "class_id")
    named = spellings.join(looks, "look").select("spelling", "class_id", "spelling_id")
    return seen.join(named, "spelling").select(key, "class_id", "spelling_id").distinct()


def lookalike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>_a, <key>_b`` (a < b): rows whose texts look the same as wholes but differ in their characters.

    Equal strings are no pair, nor are null, empty and blank texts. Pairs are made between the spellings of a class, one
    row each; then each side is replaced by its rows, which are the pairs of the result and no others.
    """
    classes = lookalike_classes(df, key, text).checkpoint()  # numbers only; read four times below
    spellings = classes.select("class_id", "spelling_id").distinct()
    one, other = spellings.withColumnRenamed("spelling_id", "one"), spellings.withColumnRenamed("spelling_id", "other")
    links = one.join(other, "class_id").filter(F.col("one") < F.col("other")).select("one", "other")
    rows = classes.select(F.col(key).alias("k"), "spelling_id")
    left = links.join(rows.select(F.col("k").alias("a"), F.col("spelling_id").alias("one")), "one")
    both = left.join(rows.select(F.col("k").alias("b"), F.col("spelling_id").alias("other")), "other").filter(F.col("a") != F.col("b"))
    return both.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b")).distinct()
