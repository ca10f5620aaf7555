"""Telling source files written by hand from generated, minified and vendored ones and from data (problem 2).

Each chunk is measured once, without its header notices; a file's measures are sums over its chunks, so no text is
shuffled. Header notices (written by a tool, or somebody else's) label files, as does a text that is mostly literals,
since no header says "this is data"; notices and the share of literals are hidden from what the forest sees. All other
files are unlabelled, not negative: the forest is fitted in rounds, and unlabelled files that look like labelled ones to
a forest that has not seen them are no longer taken for hand-written in the next round.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.splitting import is_oversized
from quarry.session import shared_folder

#: Extensions of source code.
SOURCE = ("py", "js", "ts", "go", "rs", "java", "c", "sql", "css")
#: Folders of other people's code, and of code made by tools.
VENDORED_FOLDERS = ("vendor", "vendors", "vendored", "third_party", "thirdparty", "third-party", "3rdparty", "external", "externals", "extern", "node_modules", "bower_components", "jspm_packages", "pods", "carthage", "deps", "site-packages", "dist-packages", "venv", ".venv", "godeps")
GENERATED_FOLDERS = ("__generated__", "gen", "generated", "autogen", "generated-sources", "dist", "build", "target")
#: Names of files made by tools; minified ones; copies of a released version.
GENERATED_NAME = r"(_pb2?(_grpc)?|\.pb|grpc|\.gen|[._]generated|\.g|\.designer|_gen)\.[a-z]+$"
MINIFIED_NAME = r"([.-]min|\.bundle|\.chunk|\.(?=[a-z]*[0-9])[0-9a-f]{4,20})\.[a-z]+$"
VERSION_NAME = r"-v?\d+\.\d+(\.\d+)*\.[a-z]+$"
#: Header notices of tools, in several languages, and of other projects.
TOOL_NOTICE = (
    r"@generated\b|<auto-generated|\bauto-?\s?generated\b|\bgenerated (?:by|from|at|with|on|code|file)\b|\bcode generated\b|\bmachine[- ](?:written|generated)\b"
    r"|\bregenerate (?:with|by|using|it)\b|\bautomatically (?:generated|created|produced|written)\b|\bedits? (?:are|is|will be|get) (?:overwritten|lost)\b|\bchanges will be (?:lost|overwritten)\b"
    r"|\boutput of \S+ v?\d[\d.]*, source\b|\bautomatisch (?:erzeugt|generiert)\b|\b(?:produit|généré) automatiquement\b|\bgenerado automáticamente\b|\bwygenerowan|\bсгенерирован"
)
OTHERS_NOTICE = (
    r"\breleased under the\b|\bredistribution (?:permitted|and use)\b|\bcopyright (?:\(c\) |©\s*)?(?:\d{4}[-, \d]* )?(?:the )?\S+ (?:contributors|authors|project|developers|foundation)\b"
    r"|\(c\) (?:\d{4}[-, \d]* )?the \S+ authors\b|\blicensed under the\b|\bimported unchanged from\b|\bcopied from upstream\b|\bvendored from\b|\bspdx-license-identifier\b|^\S+ v?\d+\.\d+\.\d+\s+[-|]\s|sourcemappingurl="
)
#: Notices stand in the first lines of a file.
HEADER_LINES = 14

_TOOL, _OTHERS = re.compile(TOOL_NOTICE, re.I), re.compile(OTHERS_NOTICE, re.I)
#: Fixed value: the banner that shrinking tools keep.
_KEPT_BANNER = re.compile(r"\s*/\*!\s*\S+ v?\d+(?:\.\d+)+\s*\*/")
_COMMENT = re.compile(r"\s*(?://|#(?!\[)|--|/?\*|<!--)")
_BANNER = re.compile(r"\s*/\*!?[^*\n]*\*/")
_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\w\s]")
_LITERAL = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|(?<![\w.])-?\d[\w.]*")
_DIGITS = re.compile(r"\b0x[0-9a-f]+\b|\d+", re.I)
_NO_MARKS = str.maketrans("", "", "{}[]();=<>")

#: What is added up over the chunks of a file.
MEASURES = ("n_bytes", "packed", "n_lines", "chars", "longest", "tokens", "token_bits", "names", "name_chars", "short_names", "literal_chars", "digits", "spaces", "comments", "forms", "prose_chars")
_LONGEST = 3 + MEASURES.index("longest")
#: Measures of a file: of its texts within a chunk's size limits (of all, where it has no others), and, with ``whole_``
#: before the name, of all its texts.
SHAPES = ("compression", "entropy", "name_length", "short_share", "comment_density", "line_length", "literal_share", "digit_share", "space_share", "form_share", "prose_share")
WHOLE = "whole_"
#: What the forest sees: neither notices nor the share of literals, which label.
FEATURES = (*[f for f in SHAPES if f != "literal_share"], *[WHOLE + f for f in SHAPES if f != "literal_share"], "oversized_share", "foreign_path", "made_path")


def notices(lines: list[str], first: int = 1) -> tuple[bool, bool, list[str]]:
    """Whether comments in the lines say that a tool or another project made the file; the lines without those comments.

    ``first`` is the number in the file of the first of the lines.
    """
    tool = others = False
    kept = []
    for number, line in enumerate(lines, first):
        banner = _BANNER.match(line)
        head = banner.group() if banner else line if _COMMENT.match(line) else ""
        if head and (number <= HEADER_LINES or "sourceMappingURL=" in head):
            body = re.sub(r"^[\s/*#!<-]+", "", head)
            is_tool, is_others = bool(_TOOL.search(head)), bool(_OTHERS.search(body) or _KEPT_BANNER.match(head))
            tool, others = tool or is_tool, others or is_others
            if is_tool or is_others:
                line = line[len(head) :]
                if not line.strip():
                    continue
        kept.append(line)
    return tool, others, kept


def measure(lines: list[str]) -> tuple[float, ...]:
    """The measures of one text, in the order of ``MEASURES``; all but the longest line add up over texts."""
    text = "\n".join(lines)
    raw = text.encode("utf-8", "replace")
    full = [x for x in map(str.strip, lines) if x]
    tokens = Counter(_TOKEN.findall(text))
    total = sum(tokens.values())
    names = name_chars = short = 0
    for token, times in tokens.items():
        if token[0].isalpha() or token[0] == "_":
            size = len(token)
            names += times
            name_chars += times * size
            if size < 3:
                short += times
    comments = sum(1 for x in full if x[0] in "/#-*<" and _COMMENT.match(x))
    prose = sum(len(x) for x in full if len(x) > 40 and x.count(" ") * 11 > len(x) and len(x.translate(_NO_MARKS)) * 50 > len(x) * 49 and not _COMMENT.match(x))
    return (
        len(raw), len(zlib.compress(raw, 1)), len(full), sum(map(len, full)), max(map(len, full), default=0),
        total, total * math.log2(total) - sum(c * math.log2(c) for c in tokens.values() if c > 1) if total else 0.0,
        names, name_chars, short, sum(map(len, _LITERAL.findall(text))), sum(map(text.count, "0123456789")), text.count(" ") + text.count("\t"),
        comments, len({_DIGITS.sub("0", x) for x in full}), prose,
    )


#: Bits of the set of wanted files: a fixed 8 MB at most, whatever the number of files.
WANTED_BITS = 1 << 26


def wanted_files(current: DataFrame) -> DataFrame:
    """``bucket, bits``: a bit for the hash of each file's id, in at most 2,048 rows of 4 KB."""
    place = F.pmod(F.xxhash64("file_id"), F.lit(WANTED_BITS)) + 1
    return current.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))


def of_wanted_files(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose ``file_id`` has a bit; other files may share one, which costs time, but changes no result. No shuffle."""
    place = F.pmod(F.xxhash64("file_id"), F.lit(WANTED_BITS)) + 1
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    known = rows.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(wanted), "bucket")  # 8 MB at most
    return known.filter(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1).drop("bucket", "bits")


def measure_chunks(chunks: DataFrame, current: DataFrame) -> DataFrame:
    """``file_id, regular, n_chunks, tool, others, <measures>`` of the texts of each file, oversized texts apart.

    A pass over the texts by Arrow batches, added up within each batch before anything is shuffled, then once more by
    Spark. Exact repeats of a chunk count as often as they occur. Null and blank texts are left out, and
    chunks of another kind than text (a missing kind may be text). A chunk's lines begin at the lower of its two line
    numbers, as they may be swapped; without ``start_line`` it may be the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[int, bool], list[float]] = {}
            for file, big, first, text in zip(*(c.to_pylist() for c in batch.columns)):
                lines = text.replace("\r\n", "\n").split("\n")
                tool, others, kept = notices(lines, first) if first <= HEADER_LINES or "sourceMappingURL=" in text else (False, False, lines)
                new = (1, tool, others, *measure(kept))
                own = sums.get((file, not big))
                if own is None:
                    sums[file, not big] = list(new)
                else:
                    longest = max(own[_LONGEST], new[_LONGEST])
                    own[:] = map(add, own, new)
                    own[_LONGEST] = longest
            rows = [(f, r, *v) for (f, r), v in sums.items()]
            columns = ["file_id", "regular", "n_chunks", "tool", "others", *MEASURES]
            types = [pa.int64(), pa.bool_(), *[pa.float64()] * (len(MEASURES) + 3)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], columns)

    text = F.col("text")
    begins = F.coalesce("start_line", F.lit(1))
    if "end_line" in chunks.columns:
        begins = F.least(begins, "end_line")
    textual = F.coalesce(F.lower("kind") == "text", F.lit(True))
    rows = chunks.filter(textual & F.col("file_id").isNotNull()).select(F.col("file_id").cast("long").alias("file_id"), begins.cast("int").alias("first"), "text")
    rows = of_wanted_files(rows, wanted_files(current)).filter(text.rlike(r"\S")).select("file_id", is_oversized(text).alias("big"), "first", "text")
    numbers = ", ".join(f"{c} double" for c in ("n_chunks", "tool", "others", *MEASURES))
    each = rows.mapInArrow(run, f"file_id long, regular boolean, {numbers}")
    total = [F.max("longest").alias("longest") if c == "longest" else F.sum(c).alias(c) for c in ("n_chunks", "tool", "others", *MEASURES)]
    return each.groupBy("file_id", "regular").agg(*total)


def _matches(column: Column, values: tuple[str, ...]) -> Column:
    return F.exists(F.slice(F.split(F.lower(column), "/"), 1, F.greatest(F.size(F.split(column, "/")) - 1, F.lit(1))), lambda x: x.isin(*values))


def file_features(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """``file_id, path, tool, others, n_lines, n_bytes, literal_share, whole_literal_share, <FEATURES>`` of each source-code file that has texts.

    ``oversized_share`` is the share of bytes in texts over the size limits of a chunk. Of several rows of a file the
    latest holds.
    """
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    current = files.filter(F.col("path").isNotNull() & F.col("file_id").isNotNull()).groupBy(F.col("file_id").cast("long").alias("file_id")).agg(F.max_by("path", F.struct("recorded_at", "path")).alias("path")).filter(extension.isin(*SOURCE))
    measured = measure_chunks(chunks, current)
    pick = [F.coalesce(F.max(F.when(F.col("regular"), F.col(c))), F.max(c)).alias(c) for c in MEASURES]
    pick += [(F.max(c) if c == "longest" else F.sum(c)).alias(WHOLE + c) for c in MEASURES]
    big = F.sum(F.when(F.col("regular"), 0.0).otherwise(F.col("n_bytes")))
    by_file = measured.groupBy("file_id").agg(F.max("tool").alias("tool"), F.max("others").alias("others"), big.alias("big_bytes"), *pick)
    name = F.lower(F.substring_index("path", "/", -1))
    features = {}
    for w in ("", WHOLE):
        part = lambda a, b: F.col(w + a) / F.greatest(F.col(w + b), F.lit(1.0))  # noqa: E731, B023
        features |= {w + f: c for f, c in {
            "compression": part("packed", "n_bytes"), "entropy": part("token_bits", "tokens"), "name_length": part("name_chars", "names"), "short_share": part("short_names", "names"),
            "comment_density": part("comments", "n_lines"), "line_length": part("chars", "n_lines"), "literal_share": part("literal_chars", "chars"), "digit_share": part("digits", "chars"),
            "space_share": part("spaces", "n_bytes"), "form_share": part("forms", "n_lines"), "prose_share": part("prose_chars", "chars"),
        }.items()}
    features["oversized_share"] = F.col("big_bytes") / F.greatest(F.col("whole_n_bytes"), F.lit(1.0))
    features["foreign_path"] = (_matches(F.col("path"), VENDORED_FOLDERS) | name.rlike(VERSION_NAME)).cast("double")
    features["made_path"] = (_matches(F.col("path"), GENERATED_FOLDERS) | name.rlike(GENERATED_NAME) | name.rlike(MINIFIED_NAME)).cast("double")
    joined = by_file.join(current, "file_id")
    return joined.select("file_id", "path", (F.col("tool") > 0).alias("tool"), (F.col("others") > 0).alias("others"), "n_lines", "n_bytes", *[c.alias(f) for f, c in features.items()])


#: Rows the forests are fitted on at most, drawn from all files by a hash of the id.
MOST_FITTED = 20_000
#: A file is data where literals make up half of it, or a third with as many digits as no code has.
DATA = "literal_share >= 0.5 OR literal_share >= 0.34 AND digit_share >= 0.12"
#: Scores are probabilities under equal numbers of labelled and other files: one half decides.
THRESHOLD = 0.5
#: After each round but the last, unlabelled files of this score and more are no longer taken for hand-written: a quarter
#: at first, as a kind of file whose notice is often missing is outnumbered then by its own unlabelled members.
DOUBTFUL = (0.25, 0.4)
FOLDS = 2


def _fold() -> Column:
    return F.pmod(F.xxhash64("file_id", F.lit(99)), F.lit(FOLDS))


def _held_out(rows: DataFrame, models: list, name: str) -> DataFrame:
    """Adds the score of each file by the forest that was fitted without the file's fold.

    A file with texts of both sizes is looked at twice, as it is and as if all its texts were alike; the higher score
    counts, so that neither part hides the other.
    """
    from pyspark.ml.functions import vector_to_array

    known, score = rows.columns, F.lit(None).cast("double")
    for k, model in enumerate(models):
        looks = []
        for seen in ("seen", "seen_whole"):
            look = model.copy()
            look.setFeaturesCol(seen).setProbabilityCol(f"{seen}_p{k}").setRawPredictionCol(f"{seen}_r{k}").setPredictionCol(f"{seen}_v{k}")
            rows = look.transform(rows)
            looks.append(vector_to_array(f"{seen}_p{k}")[1])
        score = F.when(_fold() == k, F.greatest(*looks)).otherwise(score)
    return rows.select(*[c for c in known if c != name], score.alias(name))


def judge(features: DataFrame, trees: int = 40, depth: int = 6, most: int = MOST_FITTED, seed: int = 5) -> DataFrame:
    """``file_id, path, score, by_forest, by_notice, not_handwritten`` of each source file.

    ``score`` comes from forests that have not seen the file's own label: files are parted into folds, and each fold is
    scored by a forest fitted on the others. ``by_forest`` is the verdict of the score, ``by_notice`` that of the file's
    own header, which a copy of ordinary code shows nowhere else; either suffices. Where there are not both labelled and
    other files in a fold's complement, only notices decide (score null).
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    shared_folder(features.sparkSession)
    whole = [f if f.startswith(WHOLE) or f not in SHAPES else WHOLE + f for f in FEATURES]
    labelled = VectorAssembler(inputCols=whole, outputCol="seen_whole", handleInvalid="keep").transform(features)
    labelled = VectorAssembler(inputCols=list(FEATURES), outputCol="seen", handleInvalid="keep").transform(labelled.withColumn("label", F.expr(f"CASE WHEN tool OR others OR {DATA} THEN 1.0 ELSE 0.0 END")))
    labelled = labelled.select("file_id", "path", "tool", "others", "label", "seen", "seen_whole").checkpoint()  # a row a source file: a few numbers each, read by counting, fitting and judging
    share = min(1.0, most / max(1, labelled.count()))
    drawn = F.pmod(F.xxhash64("file_id", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30)
    sample = labelled.filter(drawn).select("file_id", "label", "seen", "seen_whole", F.lit(0.0).alias("score")).repartition(4, "file_id").sortWithinPartitions("file_id").checkpoint()
    models: list = []
    for turn in range(len(DOUBTFUL) + 1):
        kept = sample.filter((F.col("label") == 1) | (F.col("score") < DOUBTFUL[turn - 1])) if turn else sample
        counts = {(r["fold"], r["label"]): r["count"] for r in kept.groupBy(_fold().alias("fold"), "label").count().collect()}
        models = []
        for k in range(FOLDS):
            other, own = (sum(n for (f, label), n in counts.items() if f != k and label == kind) for kind in (0.0, 1.0))
            if not other or not own:
                models = []
                break
            weighed = kept.filter(_fold() != k).withColumn("weight", F.when(F.col("label") == 1, other / own).otherwise(1.0))
            forest = RandomForestClassifier(featuresCol="seen", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", maxBins=32)
            models.append(forest.fit(weighed))
        if not models:
            break
        if turn < len(DOUBTFUL):
            sample = _held_out(sample, models, "score").checkpoint()
    scored = _held_out(labelled, models, "score")
    by_forest, by_notice = F.coalesce(F.col("score") >= THRESHOLD, F.lit(False)), F.col("tool") | F.col("others")
    return scored.select("file_id", "path", "score", by_forest.alias("by_forest"), by_notice.alias("by_notice"), (by_forest | by_notice).alias("not_handwritten"))
