"""Source divergence audit by chunk factorization.

White-space chunks are counted per document, over whole texts. A first pass counts the documents
of each (chunk, language); every globally distinct chunk is cut into terms once. A second pass
counts the occurrences of each chunk by source, joins the terms back and adds up by term.
Documents of a term don't add up, since two chunks of a document may hold the same term ("Tree",
"tree,"). A term is kept for sure if one of its chunks alone is in enough documents; the
occurrences of other chunks, which are rare, are counted by document, and the distinct documents
of a term decide. So the decision is exact, and what is shuffled is the vocabulary of the tasks.

The divergence of two sources sums over all kept terms of the language, most of which either
source lacks. Terms that a source has are counted by their number of occurrences, and the sum as
if the other lacked them all follows from these few numbers; the terms that both have correct
it, term by term in blocks, and only sums by pair of sources leave a task. All arithmetic is in
integers. The driver and the tasks hold one line for each (language, source), a table that the
result's pairs hold squared.

Defined results: null text, language and source are empty; every row is a document; only A-Z is
lower-cased; a text without white space is one chunk, whatever its length; terms of one document
count as often as they occur; a group without terms has all its pairs; a language with one
source has no pairs, and one without kept terms pairs of value 0; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import batch_limits, shuffle_partitions, store, text_of

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
HELD = 1_000_000            # (chunk, language) counts that one task holds
HELD_BYTES = 32 << 20       # of these counts
BYTES = 24 << 20            # of text whose occurrences one task counts at a time
PIECE = 1 << 20             # bytes of text that one task cuts into chunks at a time
PAIRS = 1 << 18             # pairs of occurrences that one task compares at a time
ROWS = 1 << 17              # of counts that leave a task at a time
WIDE = "decimal(38,0)"


def _texts(docs: DataFrame, *more: Column) -> DataFrame:
    batch_limits(docs.sparkSession)
    return docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"),
                       text_of().cast("binary").alias("text"), *more)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
    """The columns of as many rows as reach ``BYTES`` of text."""
    held, size = [], 0

    def whole() -> dict[str, pa.Array]:
        block = {c: pa.concat_arrays([b.column(c) for b in held]) for c in held[0].schema.names}
        held.clear()                                        # one copy of the texts at a time
        return block

    for b in batches:
        ends, lo = np.cumsum(pc.binary_length(b.column("text")).to_numpy().astype(np.int64) + 1), 0
        while lo < b.num_rows:
            before = int(ends[lo - 1]) if lo else 0
            hi = min(int(np.searchsorted(ends, before + BYTES - size)) + 1, b.num_rows)
            held.append(b.slice(lo, hi - lo))
            size += int(ends[hi - 1]) - before
            lo = hi
            if size >= BYTES:
                yield whole()
                size = 0
    if held:
        yield whole()


def _counts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct chunks of the texts, and of each text's own: text, chunk and occurrences."""
    own, found, first = [], [], 0
    for part in _pieces(texts):
        words = pc.ascii_split_whitespace(pc.ascii_lower(part.cast(pa.string())))
        coded = words.flatten().dictionary_encode()
        size = max(len(coded.dictionary), 1)
        of = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy())
        key, n = np.unique(of * size + coded.indices.to_numpy(), return_counts=True)
        of, code = np.divmod(key, size)
        full = code != coded.dictionary.index(pa.scalar("", pa.string())).as_py()   # white space at an end leaves an empty chunk
        own.append(coded.dictionary)
        found.append([x[full].astype(np.int32) for x in (of + first, code, n)])
        first += len(part)
    # the pieces' chunks as numbers of the block's
    coded = pa.chunked_array(own, pa.string()).combine_chunks().dictionary_encode()
    ends = np.cumsum([len(x) for x in own])
    code = [coded.indices.to_numpy()[end - len(x):end][c] for end, x, (_, c, _) in zip(ends, own, found)]
    none = [np.zeros(0, np.int32)]
    return coded.dictionary, np.concatenate(none + [of for of, _, _ in found]), np.concatenate(none + code), np.concatenate(none + [n for _, _, n in found])


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """As many texts at a time as begin in the same ``PIECE`` bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 1)
    at = np.r_[0, np.flatnonzero(np.diff(ends // PIECE)) + 1, len(texts)]
    return (texts.slice(lo, hi - lo) for lo, hi in zip(at[:-1], at[1:]) if hi > lo)


def chunk_terms(docs: DataFrame, lid_of: dict[str, int]) -> DataFrame:
    """(chunk, langs, terms) of every distinct chunk: its documents by number of the language, and
    its terms in text order, if any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kinds = [], pa.schema([("lid", pa.int32()), ("chunk", pa.string()), ("docs", pa.int64())])

        def merged() -> pa.Table:
            table = pa.concat_tables(held)
            if len(held) > 1:
                table = table.group_by(["lid", "chunk"], use_threads=False).aggregate([("docs", "sum")]).rename_columns(["lid", "chunk", "docs"]).cast(kinds)
            held[:] = [table]
            return table

        def count(block: dict[str, pa.Array]) -> None:
            langs = block["lang"].dictionary_encode()
            chunks, of, code, _ = _counts(block["text"])
            in_lang = langs.indices.to_numpy()[of]
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                documents = np.bincount(code[in_lang == i], minlength=len(chunks))
                found = np.flatnonzero(documents)
                held.append(pa.table([pa.repeat(pa.scalar(lid_of[lang], pa.int32()), len(found)), chunks.take(pa.array(found)), pa.array(documents[found])], kinds))

        for _ in map(count, _blocks(batches)):              # a block goes when it is counted
            table = merged()
            if len(table) >= HELD or table.nbytes >= HELD_BYTES:
                yield from table.to_batches(ROWS)
                held.clear()
        if held:
            yield from merged().to_batches(ROWS)
        pa.default_memory_pool().release_unused()           # workers outlive their tasks

    # one exchange, by chunk, for both groupings; a chunk has one row a language and task
    parts = _texts(docs).mapInArrow(run, "lid int, chunk string, docs long").repartition(shuffle_partitions(docs.sparkSession), "chunk")
    return (parts.groupBy("chunk", "lid").agg(F.sum("docs").alias("docs"))
            .groupBy("chunk").agg(F.collect_list(F.struct("lid", "docs")).alias("langs"))
            .select("chunk", F.map_from_entries("langs").alias("langs"), F.regexp_extract_all("chunk", F.lit(TERM), F.lit(0)).alias("terms")))


def chunk_occurrences(docs: DataFrame, sid_of: dict[tuple[str, str], int], lid_of: dict[str, int], min_docs: int) -> DataFrame:
    """(chunk, sid, n, doc): the occurrences of a task, by document (the row's number) for
    chunks that are in fewer than ``min_docs`` of its documents of the language; doc is null for others."""
    lids = np.zeros(len(sid_of), np.int64)
    for (lang, _), sid in sid_of.items():
        lids[sid] = lid_of[lang]

    def frame(chunks: pa.Array, code: np.ndarray, sid: np.ndarray, n: np.ndarray, doc: pa.Array) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(code), ROWS):
            part = slice(lo, lo + ROWS)
            yield pa.RecordBatch.from_pydict({"chunk": chunks.take(pa.array(code[part])), "sid": pa.array(sid[part].astype(np.int32)),
                                              "n": pa.array(n[part].astype(np.int64)), "doc": doc[part]})

    def counted(block: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        sids = np.array([sid_of[g] for g in zip(block["lang"].to_pylist(), block["source"].to_pylist())], dtype=np.int32)
        chunks, of, code, n = _counts(block["text"])
        sid, size = sids[of], max(len(chunks), 1)
        key = lids[sid] * size + code
        each, documents = np.unique(key, return_counts=True)
        often = pc.is_in(pa.array(key), pa.array(each[documents >= min_docs])).to_numpy(zero_copy_only=False)
        del key, each, documents
        rare = ~often
        yield from frame(chunks, code[rare], sid[rare], n[rare], pa.array(block["doc"].to_numpy()[of[rare]]))
        key, n = sid[often].astype(np.int64) * size + code[often], n[often]
        order = np.argsort(key)
        key, n = key[order], n[order]
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else order
        key, n = key[heads], np.add.reduceat(n, heads, dtype=np.int64)
        yield from frame(chunks, key % size, key // size, n, pa.nulls(len(key), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in map(counted, _blocks(batches)):         # a block goes when it is counted
            yield from rows
        pa.default_memory_pool().release_unused()

    return _texts(docs, F.monotonically_increasing_id().alias("doc")).mapInArrow(run, "chunk string, sid int, n long, doc long")


def term_counts(docs: DataFrame, sid_of: dict[tuple[str, str], int], min_docs: int = 3) -> DataFrame:
    """(lang, term, sid, n): for each term in at least ``min_docs`` documents of the language, the
    sources where it occurs and its occurrences there, as arrays."""
    lid_of = {lang: i for i, lang in enumerate(sorted({lang for lang, _ in sid_of}))}
    # a source tells its language, which so need not travel with the counts
    small = lambda rows, columns: F.broadcast(docs.sparkSession.createDataFrame(rows, columns))
    lids = small([(sid, lid_of[lang]) for (lang, _), sid in sid_of.items()], "sid int, lid int")
    # a partition of the chunks is vocabulary, which fits in memory where a partition of counts need not;
    # counts are exchanged to where the chunks are counted, and added up there before their terms travel
    every = chunk_occurrences(docs, sid_of, lid_of, min_docs).join(chunk_terms(docs, lid_of).hint("shuffle_hash"), "chunk").join(lids, "sid")
    sure = F.element_at("langs", F.col("lid")) >= min_docs
    each = every.select("chunk", "sid", "n", sure.alias("sure"), F.when(~sure, F.col("doc")).alias("doc"), F.explode_outer("terms").alias("term"))
    # chunks without terms go here: a filter on the terms would move below the join and cut the terms of each row of it
    each = each.filter("term is not null").groupBy("chunk", "term", "sid", "doc").agg(F.sum("n").alias("n"), F.max("sure").alias("sure"))
    # one exchange, by term, for all three groupings
    each = each.select("term", "sid", "doc", "n", "sure").repartition(shuffle_partitions(docs.sparkSession), "term")
    flat = each.groupBy("term", "sid", "doc").agg(F.sum("n").alias("n"), F.max("sure").alias("sure"))
    flat = flat.groupBy("term", "sid").agg(F.sum("n").alias("n"), F.max("sure").alias("sure"), F.count("doc").alias("docs"))
    # one entry a source
    terms = flat.join(lids, "sid").groupBy("lid", "term").agg(F.collect_list(F.struct("sid", "n")).alias("own"), F.max("sure").alias("sure"),
                                                              F.sum("docs").alias("docs"))
    kept = terms.filter(F.col("sure") | (F.col("docs") >= min_docs)).join(small([(i, lang) for lang, i in lid_of.items()], "lid int, lang string"), "lid")
    return store(kept.select("lang", "term", "own.sid", "own.n"), "terms")


def weight(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(1000000000 * (n + 1) / (total + v)); null without kept terms."""
    whole = F.nullif(total + v, F.lit(0)).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), whole)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _weights(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    if n.max(initial=0) >= 9_000_000_000:                   # beyond 64 bits
        n = n.astype(object)
    return (1 + 1_000_000_000 * (n + 1) // whole).astype(np.int64)


def _divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _shared(sid: np.ndarray, size: np.ndarray, p: np.ndarray, p0: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, value): what the terms that both of a pair of sources have add to the sum as if
    either lacked the other's."""
    others = np.repeat(size, size)                          # of each entry: the entries of its term
    first = np.repeat(np.cumsum(size) - size, size)
    upto, lo, f = np.cumsum(others), 0, _divergences
    while lo < len(sid):                                    # entries whose pairs fit into a block, one at least
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
        k = others[lo:hi]
        a = np.repeat(np.arange(lo, hi), k)
        b = np.repeat(first[lo:hi], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        a, b, lo = a[a != b], b[a != b], hi
        value = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
        order = np.lexsort((sid[b], sid[a]))
        a, b, value = sid[a][order], sid[b][order], value[order]
        heads = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else a
        if len(heads):
            yield a[heads], b[heads], np.add.reduceat(value, heads)


def _highest(sid: np.ndarray, value: np.ndarray, top: int) -> np.ndarray:
    """Where a source's ``top`` largest values are, with all that equal the last of them."""
    order = np.lexsort((-value, sid))
    s, v = sid[order], value[order]
    heads = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    size = np.diff(np.r_[heads, len(s)])
    least = v[heads + np.minimum(size, top) - 1]
    return order[v >= np.repeat(least, size)]


def _measures(terms: DataFrame, whole: np.ndarray, in_lang: dict[str, tuple[int, int]], top: int) -> DataFrame:
    """(part, a, b, item, value): ``term`` candidates of the ranking of a, ``own`` counts of a's
    terms with b occurrences, ``shared`` parts of the sums of the pairs (a, b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("sid").value_lengths().to_numpy().astype(np.int64)
            sid, n = batch.column("sid").flatten().to_numpy(), batch.column("n").flatten().to_numpy()
            p, p0 = _weights(n, whole[sid]), _weights(np.zeros_like(n), whole[sid])
            every, v = np.array([in_lang[lang] for lang in batch.column("lang").to_pylist()], dtype=np.int64).T
            q = np.repeat(_weights(np.add.reduceat(n, np.cumsum(size) - size), every + v), size)
            more = np.flatnonzero(p > q)
            if len(more):
                value = _divergences(p[more], q[more])
                best = _highest(sid[more], value, top)
                row = np.repeat(np.arange(batch.num_rows), size)[more[best]]
                yield frame("term", sid[more[best]], value[best], item=batch.column("term").take(pa.array(row)))
            order = np.lexsort((n, sid))
            s, m = sid[order], n[order]
            heads = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (m[1:] != m[:-1])])
            yield frame("own", s[heads], np.diff(np.r_[heads, len(s)]), b=m[heads])
            for a, b, value in _shared(sid, size, p, p0):
                yield frame("shared", a, value, b=b)
        pa.default_memory_pool().release_unused()

    def frame(part: str, a: np.ndarray, value: np.ndarray, b: np.ndarray | None = None, item: pa.Array | None = None) -> pa.RecordBatch:
        size = len(a)
        return pa.RecordBatch.from_pydict({
            "part": pa.repeat(part, size), "a": pa.array(np.asarray(a, np.int32)),
            "b": pa.nulls(size, pa.int64()) if b is None else pa.array(np.asarray(b, np.int64)),
            "item": pa.nulls(size, pa.string()) if item is None else item,
            "value": pa.array(np.asarray(value, np.int64))})

    return terms.mapInArrow(run, "part string, a int, b long, item string, value long")


def pair_divergences(measures: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, value) of every ordered pair of a language's sources."""
    one = groups.select("lang", F.col("sid").alias("a"), "p0", "total", "v")
    two = groups.select("lang", F.col("sid").alias("b"), F.col("p0").alias("b0"))
    pairs = one.join(two, "lang").filter("a <> b")
    neither = pairs.select("a", "b", F.coalesce(F.col("v").cast(WIDE) * divergence(F.col("p0"), F.col("b0")), F.lit(0)).alias("value"))
    numbers = (measures.filter("part = 'own'").groupBy("a", F.col("b").alias("n")).agg(F.sum("value").cast("decimal(18,0)").alias("m"))
               .join(one, "a").withColumn("p", weight(F.col("n"), F.col("total"), F.col("v"))))
    each = numbers.join(two, "lang").filter("a <> b")
    floor_ab, floor_ba = divergence(F.col("p0"), F.col("b0")), divergence(F.col("b0"), F.col("p0"))
    only_a = each.select("a", "b", F.col("m") * (divergence(F.col("p"), F.col("b0")) - floor_ab))
    only_b = each.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("m") * (divergence(F.col("b0"), F.col("p")) - floor_ba))
    both = measures.filter("part = 'shared'").select("a", F.col("b").cast("int").alias("b"), "value")
    return neither.union(only_a).union(only_b).union(both).groupBy("a", "b").agg(F.sum("value").cast("long").alias("value"))


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` ranks the other sources of the
    language, part ``term`` the ``top`` terms that the source has more of than its language."""
    spark = docs.sparkSession
    names = sorted(tuple(r) for r in docs.select(text_of("lang"), text_of("source")).distinct().collect())
    terms = term_counts(docs, {g: i for i, g in enumerate(names)}, min_docs)
    each = terms.select(F.explode(F.arrays_zip("sid", "n")).alias("e")).groupBy("e.sid").agg(F.sum("e.n").alias("n"))
    totals, vs = dict(map(tuple, each.collect())), dict(map(tuple, terms.groupBy("lang").count().collect()))
    every = Counter()
    for i, (lang, _) in enumerate(names):
        every[lang] += totals.get(i, 0)
    groups = [(lang, source, i, totals.get(i, 0), vs.get(lang, 0)) for i, (lang, source) in enumerate(names)]
    whole = np.array([g[3] + g[4] for g in groups], dtype=np.int64)
    measures = store(_measures(terms, whole, {lang: (every[lang], v) for lang, v in vs.items()}, top), "measures")
    groups = spark.createDataFrame(groups, "lang string, source string, sid int, total long, v long").withColumn(
        "p0", weight(F.lit(0), F.col("total"), F.col("v")))
    own, other = groups.select("lang", "source", F.col("sid").alias("a")), groups.select(F.col("source").alias("item"), F.col("sid").alias("b"))
    pairs = pair_divergences(measures, groups).join(other, "b").select("a", "item", "value")
    more = measures.filter("part = 'term'").select("a", "item", "value")
    w = Window.partitionBy("a").orderBy(F.desc("value"), "item")
    ranked = [df.withColumn("rank", F.row_number().over(w)).withColumn("part", F.lit(part)) for df, part in ((pairs, "pair"), (more, "term"))]
    every = ranked[0].union(ranked[1].filter(F.col("rank") <= top)).join(own, "a")
    return every.select("lang", "source", "part", "item", "value", "rank")
