"""The queries of the text operators, by name."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import fusion, handwritten, lookalike, neighbours, packing, splitting, tokens
from quarry.session import table, wide_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(splitting.once(wide_table(spark, sf, "chunks", "chunk_id", "start_line", "text")))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_chunks(splitting.split_oversized(table(spark, sf, "chunks")))


def p2_files(spark: SparkSession, sf: str) -> DataFrame:
    features = handwritten.file_features(wide_table(spark, sf, "chunks", "file_id", "kind", "start_line", "end_line", "text"), table(spark, sf, "files"))
    return handwritten.judge(features).withColumn("score", F.round("score", 6))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_files(spark, sf).filter("not_handwritten").select("file_id")


#: Pairs to be found are at least this similar.
SIMILAR = 0.90


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    near = neighbours.nearest_neighbours(wide_table(spark, sf, "chunks", "chunk_id", "embedding"), floor=SIMILAR)
    return neighbours.similar_pairs(near, SIMILAR)


def p3_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 nearest of every hundredth chunk among all chunks."""
    near = neighbours.nearest_neighbours(wide_table(spark, sf, "chunks", "chunk_id", "embedding"), queries=F.col("id") % 100 == 0)
    return near.select(F.col("id").alias("chunk_id"), "neighbour")


def p5_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse_scores(table(spark, sf, "search_results"), table(spark, sf, "search_queries"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_ranking(spark, sf).filter("position = 1").select("query_id", "chunk_id")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_texts(wide_table(spark, sf, "documents", "doc_id", "text"))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(wide_table(spark, sf, "documents", "doc_id", "text"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.container_fill(p7_containers(spark, sf))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return packing.split_documents(p7_containers(spark, sf))


def p8_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.with_canonical(wide_table(spark, sf, "documents", "doc_id", "text"))


def p8_classes(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.lookalike_classes(wide_table(spark, sf, "documents", "doc_id", "text"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.lookalike_pairs(wide_table(spark, sf, "documents", "doc_id", "text"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_files, p3_found, p3_neighbours, p5_found, p5_ranking, p6_ids, p7_found, p7_containers, p7_fill, p8_found, p8_classes, p8_canonical)}

# The looks of texts character by character: what each becomes is told by a table of this module's own, from Python's
# character database; white space, marks of direction and the like are taken by their categories; a joiner after a pictograph is kept.
_SPACES = "".join(c for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) == "Zs")
_HIDDEN = "".join(c for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) == "Cf" and not 0x600 <= ord(c) < 0x606 or 0xFE00 <= ord(c) < 0xFE10)
_PLAIN = {c: unicodedata.normalize("NFKC", c) for c in map(chr, range(0x80, 0x1F000)) if unicodedata.decomposition(c).split(" ")[0] in lookalike.ALIKE_FORMS and c not in lookalike.DIFFERENT_FORMS and " " not in unicodedata.normalize("NFKC", c)}
_PLAIN = {c: to for c, to in _PLAIN.items() if len(to) == 1 or c in lookalike.several_forms()} | dict(lookalike.LOOK_ALIKES)
_PLAIN = {c: "".join(lookalike.LOOK_ALIKES.get(x, x) for x in to) for c, to in _PLAIN.items()} | {c: " " for c in _SPACES}
_PLAIN |= {c: unicodedata.normalize("NFC", lookalike.LOOK_ALIKES[d[0]] + d[1:]) for c in map(chr, range(0xC0, 0x3000)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0] in lookalike.LOOK_ALIKES}


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_PIECES = f"list_transform(string_split(nfc_normalize(translate(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '([\\x{{2600}}-\\x{{27BF}}\\x{{FE0F}}\\x{{1F000}}-\\x{{1FAFF}}])\\x{{200D}}', '\\1' || chr(57344), 'g'), '{_HIDDEN}', '')), ''), lambda c: coalesce(element_at(m, c)[1], c))"
_LOOKS = f"""WITH t AS (SELECT doc_id, text, map({_list(_PLAIN)}, {_list(_PLAIN.values())}) AS m FROM documents WHERE regexp_matches(text, '[^\\x00-\\x7F]')),
forms AS (SELECT doc_id, text, nfc_normalize(array_to_string({_PIECES}, '')) AS look FROM t
  UNION ALL SELECT doc_id, text, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]')),
looks AS (SELECT * FROM forms WHERE regexp_matches(look, '\\S'))"""

SQL: dict[str, str] = {
    "p1_found": r"""SELECT DISTINCT chunk_id FROM chunks
WHERE strlen(text) > 3000 OR length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END > 30""",
    "p3_found": """WITH v AS (SELECT DISTINCT chunk_id, embedding::DOUBLE[] AS e, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS n FROM chunks WHERE len(embedding) > 0)
SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM v a JOIN v b ON a.chunk_id < b.chunk_id AND len(a.e) = len(b.e)
WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) >= 9e-1 * sqrt(a.n) * sqrt(b.n)""",
    "p3_neighbours": """WITH v AS (SELECT DISTINCT chunk_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM chunks WHERE len(embedding) > 0 AND chunk_id IS NOT NULL),
s AS (SELECT a.chunk_id, b.chunk_id AS neighbour, max(round(list_dot_product(a.e, b.e) / (a.n * b.n), 7)) AS s FROM v a JOIN v b ON a.chunk_id <> b.chunk_id AND len(a.e) = len(b.e) WHERE a.chunk_id % 100 = 0 AND a.n > 0 AND b.n > 0 GROUP BY 1, 2)
SELECT chunk_id, neighbour FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY s DESC, neighbour) AS k FROM s) WHERE k <= 10""",
    "p8_found": f"{_LOOKS} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM looks a JOIN looks b ON a.look = b.look AND a.text <> b.text AND a.doc_id < b.doc_id",
    "p8_classes": f"""{_LOOKS}, classes AS (SELECT look, min(doc_id) AS class_id FROM looks GROUP BY 1 HAVING count(DISTINCT text) > 1)
SELECT DISTINCT doc_id, class_id, min(doc_id) OVER (PARTITION BY look, text) AS spelling_id FROM looks JOIN classes USING (look)""",
}
