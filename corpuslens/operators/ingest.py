"""Documents to blocks to chunks, by expressions and one pass over the lengths of each section."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.functions.vectors import hash_vectors
from corpuslens.operators.search import postings
from corpuslens.sources.sliced import written

SENTENCE_ENDS = "。；！？!?;"
#: White space of the patterns, rows of a batch of texts that Python gets, and texts whose words are counted at a time.
WHITE, BATCH_ROWS, COUNTED_DOCS = " \t\n\x0b\f\r", 1000, 256


def new_documents(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of a batch whose (kb_id, file_hash) is not stored yet, the smallest doc_id of each."""
    fresh = batch.join(stored.select("kb_id", "file_hash").distinct(), ["kb_id", "file_hash"], "left_anti")
    at = W.partitionBy("kb_id", "file_hash").orderBy("doc_id")
    return fresh.withColumn("n", F.row_number().over(at)).where("n = 1").drop("n")


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, text, block_type, heading_level, heading_title, clause_no) of paragraphs between blank lines."""
    paras = docs.select("doc_id", F.posexplode(F.split(T.clean_text(F.col("text")), r"\n\s*\n")).alias("pos", "raw"))
    paras = paras.select("doc_id", "pos", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("text")).where("text <> ''")
    heads, numbers = r"^(#{1,6})\s+(.*)$", r"^\s*(\d{1,2}(?:\.\d{1,3}){0,3})\s+(\S[^\n]{0,60})$"
    paras = paras.withColumn("first", F.substring_index("text", "\n", 1))
    paras = paras.withColumns({name: F.regexp_extract("first", of, i) for name, of, i in (("mark", heads, 1), ("title", heads, 2), ("num", numbers, 1), ("num_title", numbers, 2))})
    mark, title, num, num_title = map(F.col, ("mark", "title", "num", "num_title"))
    md, numbered = (mark != "") & (F.length("text") < 200), (num != "") & (F.length("text") < 90)
    return paras.select(
        "doc_id", "pos", "text", F.when(md | numbered, "heading").otherwise("paragraph").alias("block_type"),
        F.when(md, F.length(mark)).when(numbered, F.size(F.split(num, r"\."))).alias("heading_level"),
        F.when(md, F.trim(title)).when(numbered, F.trim(num_title)).alias("heading_title"), F.when(~md & numbered, num).otherwise("").alias("clause_no"),
    )


def section_paths(b: DataFrame, levels: int = 6) -> DataFrame:
    """Adds section_path: the last heading of each level that no later, shallower heading has ended."""
    at = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    for n in range(1, levels + 1):
        here = F.when(F.col("heading_level") == n, F.struct("pos", F.substring("heading_title", 1, 80).alias("title")))
        b = b.withColumn(f"h{n}", F.last(here, ignorenulls=True).over(at))
    parts = []
    for n in range(1, levels + 1):
        later = F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(f"h{m}.pos", F.lit(-1)) for m in range(1, n)])
        parts.append(F.when(F.col(f"h{n}.pos") > later, F.col(f"h{n}.title")))
    return b.withColumn("section_path", F.concat_ws(" > ", *parts)).drop(*[f"h{n}" for n in range(1, levels + 1)])


def _flush_groups(sizes: Column, size: int) -> Column:
    """Group number of each block: a group ends once it holds `size` characters. One pass over the lengths of a section."""

    @F.pandas_udf("array<int>")
    def groups(sizes: pd.Series) -> pd.Series:
        out = []
        for row in sizes:
            g, held, mine = 0, 0, []
            for n in row if row is not None else ():
                mine.append(g)
                held += n
                if held >= size:
                    g, held = g + 1, 0
            out.append(mine)
        return pd.Series(out)

    return groups(sizes)


def pack_sentences(text: Column, size: int, overlap: int, ends: str = SENTENCE_ENDS, trim: bool = False) -> Column:
    """Sentences packed to `size` characters; each pack but the first begins with the end of the one before. `trim` takes white
    space from the ends of the packs that are given.

    Borders follow from the sentences' lengths alone: a pack is a stretch of the sentences put together, since what it repeats
    stands right before it. So a text of any length is cut in one pass, each character taken at most twice by a pack's border.
    """
    sentence = f"[^{re.escape(ends)}]*[{re.escape(ends)}]|[^{re.escape(ends)}]+"

    @F.pandas_udf("array<string>")
    def packs(text: pd.Series) -> pd.Series:
        find, out = re.compile(sentence).findall, []
        for t in text:
            if t is None or len(t) <= size:
                out.append(None if t is None else [t])
                continue
            parts = [s for s in find(t) if s.strip(" ")]
            whole, at, start, mine = "".join(parts), 0, 0, []
            for s in parts:
                if at - start + len(s) > size and at > start:
                    mine.append(whole[start:at])
                    start = max(at - overlap, start)
                at += len(s)
            if whole[start:].strip(" "):
                mine.append(whole[start:])
            out.append(mine)
        return pd.Series([[p.strip(WHITE) for p in mine] if trim and mine is not None else mine for mine in out])

    return packs(text)


def page_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of extracted pages (doc_id, page_no, text), with their page: paragraphs of two characters or more, numbered
    headings and appendix headings. Null and empty pages have none."""
    paras = pages.select("doc_id", "page_no", F.posexplode(F.split(T.clean_text(F.col("text")), r"\n\s*\n")).alias("k", "raw"))
    paras = paras.select("doc_id", "page_no", "k", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("text")).where(F.length("text") >= 2)
    first = F.element_at(F.split("text", "\n"), 1)
    num, title = (F.regexp_extract(first, r"^\s*(\d{1,2}(?:\.\d{1,3}){0,3})\s+([^\n]{2,60})$", i) for i in (1, 2))
    numbered, appendix = (num != "") & (F.length("text") < 80), F.col("text").rlike(r"^\s*附录\s*[A-Z]\s*[^\n]{0,60}$")
    pos = F.row_number().over(W.partitionBy("doc_id").orderBy("page_no", "k")) - 1
    return paras.select(
        "doc_id", pos.alias("pos"), "page_no", "text", F.when(numbered | appendix, "heading").otherwise("paragraph").alias("block_type"),
        F.when(numbered, F.size(F.split(num, r"\."))).when(appendix, 1).alias("heading_level"),
        F.when(numbered, F.trim(title)).when(appendix, F.col("text")).alias("heading_title"), F.when(numbered, num).otherwise("").alias("clause_no"),
    )


def chunks(docs: DataFrame, size: int = 600, overlap: int = 100, least: int = 40, ends: str = SENTENCE_ENDS) -> DataFrame:
    """(doc_id, seq, content, section_path, clause_no, page_no, is_mandatory, char_count) of whole documents."""
    return chunks_of(blocks(docs), size, overlap, least, ends)


def chunks_of(b: DataFrame, size: int = 600, overlap: int = 100, least: int = 40, ends: str = SENTENCE_ENDS) -> DataFrame:
    """Chunks of blocks, as `blocks` or `page_blocks` gives them or with tables (block_type `table`): a table is one chunk,
    whatever its size. The page is that of a chunk's first block with one."""
    b.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))  # of whole texts, so that a worker's memory is bounded
    if "page_no" not in b.columns:
        b = b.withColumn("page_no", F.lit(None).cast("int"))
    at = W.partitionBy("doc_id").orderBy("pos")
    is_table = F.col("block_type") == "table"
    b = section_paths(b).withColumn("is_table", is_table).withColumn("opens", (F.col("block_type") == "heading") | is_table | F.coalesce(F.lag("is_table").over(at), F.lit(False)))
    b = b.withColumn("sec", F.sum(F.col("opens").cast("int")).over(at.rowsBetween(W.unboundedPreceding, 0)))
    by = ["doc_id", "sec", "section_path", "is_table"]
    sec = b.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "text", "clause_no", "page_no"))).alias("parts"))  # the blocks of one section of one document
    sec = sec.withColumn("groups", _flush_groups(F.transform("parts", lambda p: F.length(p["text"])), size))
    flat = sec.select(*by, F.explode(F.arrays_zip("parts", "groups")).alias("p"))
    merged = flat.groupBy(*by, F.col("p.groups").alias("g")).agg(F.sort_array(F.collect_list("p.parts")).alias("parts"))
    text = T.clean_text(F.array_join(F.transform("parts", lambda p: p["text"]), "\n"))
    clause = F.coalesce(F.get(F.filter(F.transform("parts", lambda p: F.when(p["clause_no"] != "", p["clause_no"]).otherwise(T.clause_no(p["text"]))), lambda c: c != ""), F.lit(0)), F.lit(""))
    page = F.get(F.filter(F.transform("parts", lambda p: p["page_no"]), lambda n: n.isNotNull()), F.lit(0))
    # What is beside a generator is computed for each of its rows, so a group's text is cleaned and cut before its packs are told apart.
    merged = merged.select("doc_id", "sec", "g", "is_table", "section_path", clause.alias("clause"), page.alias("page_no"), text.alias("whole"))
    packs = F.when(F.col("is_table"), F.array("whole")).otherwise(pack_sentences(F.col("whole"), size, overlap, ends, trim=True))
    merged = merged.select("doc_id", "sec", "g", "section_path", "clause", "page_no", (~F.col("is_table") & (F.length("whole") > size)).alias("cut"), packs.alias("packs"))
    each = merged.select("doc_id", "sec", "g", "section_path", "clause", "page_no", "cut", F.posexplode("packs").alias("k", "t"))
    t = F.col("t")
    own = F.when(F.col("cut") & (T.clause_no(t) != ""), T.clause_no(t)).otherwise(F.col("clause"))
    out = each.select("doc_id", "sec", "g", "k", "section_path", own.alias("clause_no"), "page_no", T.is_mandatory(t).alias("is_mandatory"), T.with_section(F.col("section_path"), t).alias("content"))
    out = out.withColumn("char_count", F.length("content")).where((F.col("char_count") > 0) & ((F.col("char_count") >= least) | (F.col("clause_no") != "")))
    seq = F.row_number().over(W.partitionBy("doc_id").orderBy("sec", "g", "k")) - 1
    return out.withColumn("seq", seq).select("doc_id", "seq", "content", "section_path", "clause_no", "page_no", "is_mandatory", "char_count")


def attributes(docs: DataFrame, k: int = 15) -> DataFrame:
    """(doc_id, standard_code, summary, keywords): the given code or else the first of the opening 3,000 characters, whole
    sentences up to 220 characters, and the keywords of the first 8,000. These lengths are what the attributes are about."""
    given = F.col("standard_code") if "standard_code" in docs.columns else F.lit("")
    head = docs.select("doc_id", F.substring(T.text_or_empty(F.col("text")), 1, 8000).alias("text"))
    own = docs.select("doc_id", F.when(T.blank(given), T.standard_code(F.substring("text", 1, 3000))).otherwise(given).alias("standard_code"), T.summary(F.col("text"), 220).alias("summary"))
    return own.join(keywords(head, k), "doc_id", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def with_chunk_id(c: DataFrame) -> DataFrame:
    """Adds chunk_id, `doc_id-seq`."""
    return c.withColumn("chunk_id", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("seq").cast("string")))


def index_rows(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors (chunk_id, bucket, value) and postings (kb_id, chunk_id, term, tf, dl) of chunks with chunk_id and kb_id."""
    return hash_vectors(c, "chunk_id", "content"), postings(c, "chunk_id", "kb_id", "content")


def ingested(batch: DataFrame, stored: DataFrame, size: int = 600, overlap: int = 100, least: int = 40, ends: str = SENTENCE_ENDS) -> dict[str, DataFrame]:
    """`documents`, `chunks`, `vectors` and `postings` of the new documents of a batch (doc_id, kb_id, text, any more).

    Documents already in `stored` (kb_id, file_hash), and repeats within the batch, are left out. A document without any
    chunk has the status `failed` and an error, others `ready`. Write `chunks` before the rest is taken from it where its
    making is dear. Null texts fail; doc_id is distinct.
    """
    new = new_documents(batch.withColumn("file_hash", T.content_hash(F.col("text"))), stored)
    c = with_chunk_id(chunks(new, size, overlap, least, ends).join(new.select("doc_id", "kb_id"), "doc_id"))
    n = c.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    docs = new.drop("standard_code", "summary", "keywords", "status", "chunk_count", "error_msg").join(attributes(new), "doc_id").join(n, "doc_id", "left").fillna(0, ["chunk_count"])
    none = F.col("chunk_count") == 0
    docs = docs.withColumns({"status": F.when(none, "failed").otherwise("ready"), "error_msg": F.when(none, "no chunk holds enough text").otherwise("")})
    vectors, posts = index_rows(c)
    return {"documents": docs, "chunks": c, "vectors": vectors, "postings": posts}


def reindexed(vectors: DataFrame, posts: DataFrame, c: DataFrame, doc_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors and postings after the stored chunks (chunk_id, doc_id, kb_id, content, is_deleted) of `doc_ids` were indexed
    anew: rows of their chunks go, and those of chunks that are not deleted come back. Others are untouched."""
    mine = c.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    v, p = index_rows(mine.where(~F.coalesce("is_deleted", F.lit(False))))
    ids = mine.select("chunk_id").distinct()
    return vectors.join(ids, "chunk_id", "left_anti").unionByName(v), posts.join(ids, "chunk_id", "left_anti").unionByName(p)


def keywords(docs: DataFrame, k: int = 12, terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, keywords): domain terms first, then by count, length and first place. Without terms, a document is counted where it
    is and only its keywords leave the task; rows that share an id are counted together, by shuffle, as are all where there are terms."""
    if terms is not None:
        return _shuffled_keywords(docs, k, terms)
    given = docs.select("doc_id", "text")
    twice = written(given.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id")), "repeated-ids")
    if twice.isEmpty():
        return _own_keywords(given, k)
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    return _own_keywords(given.join(twice, same, "left_anti"), k).unionByName(_shuffled_keywords(given.join(twice, same, "left_semi"), k))


def _own_keywords(docs: DataFrame, k: int) -> DataFrame:
    """Keywords of documents with ids of their own."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (w.slice(lo, COUNTED_DOCS) for w in batches for lo in range(0, w.num_rows, COUNTED_DOCS)):
            best = []
            for text in b.column("text").to_pylist():
                n = T.token_counts(text)  # in the order of first places, which sorting keeps
                best.append(sorted((w for w in n if len(w) >= 2), key=lambda w, n=n: (-n[w], -len(w)))[:k] or None)
            found = pa.array(best, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), found], names=["doc_id", "keywords"]).filter(found.is_valid())

    return docs.mapInArrow(run, f"doc_id {kind}, keywords array<string>")


def _shuffled_keywords(docs: DataFrame, k: int, terms: DataFrame | None = None) -> DataFrame:
    t = docs.select("doc_id", F.posexplode(T.tokenize(F.col("text"))).alias("pos", "token")).where(F.length("token") >= 2)
    t = t.groupBy("doc_id", "token").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    t = t.withColumn("known", F.lit(False)) if terms is None else t.join(terms.select(F.lower("term").alias("token"), F.lit(True).alias("known")).distinct(), "token", "left").fillna(False, ["known"])
    at = W.partitionBy("doc_id").orderBy(F.desc("known"), F.desc("n"), F.desc(F.length("token")), "pos")
    best = t.withColumn("r", F.row_number().over(at)).where(F.col("r") <= k)
    return best.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "token"))), lambda x: x["token"]).alias("keywords"))
