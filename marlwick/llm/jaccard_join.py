"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word n-grams.  Similar sets are put into groups, and of each group the union of its tokens is kept as its
row of the token-group matrix.  Every set is a query.  Its overlap with a group's row bounds its overlap with every member, so
only groups whose bound reaches what the threshold asks for are opened, and there members are compared exactly.

The matrix holds prefixes.  With tokens in one global order, two sets of Jaccard index t or more share k of their first
len - ceil(t * len) + k tokens, for any k up to ceil(t * len) of either.  A row is the union of its members' prefixes, and a
query overlaps it in k places at least if it is similar to a member.  So no pair can be missed, whatever the order and
whatever the groups; an order that puts frequent tokens last, and groups of like sets, only make for few openings.  Before
members are compared, the query is held against the union of their whole sets.

Two sets of a and b tokens need t / (1 + t) * (a + b) common ones, so the first k of them are the sooner in both sets the more
alike in size they are.  A token at some place of a prefix is of use against partners up to some size only; it goes with that
size, in classes of an eighth of an octave, and postings that suit no other one are not counted.

Groups: all sets with a prefix token are tied to the least of them; a set joins the one it has the most ties with, if these are
k at least, and that one's group in turn.  A large group gets a pivot, the member with the most shared tokens.  Jaccard
distance is a metric, so members within (1 - t) / 2 of the pivot are all similar to one another and need no comparing; only
the others are queries.  Nothing that is emitted, shuffled or gathered is by pairs.

Defined cases: words are lower-cased runs between white space.  A text of fewer than n words is one token.  Null and empty
texts have no tokens and are similar to nothing.  Rows without doc_id can't be named and take no part.  Rows that repeat a
doc_id with one text are one document; a doc_id with several texts has the links of all of them together and the least of
their classes.  Sets are told apart by 61-bit hashes.  Columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hashed, lean, ngram_hashes, shuffle_width, slices, small_or_shuffled, table, word_hashes, words_of

N, THRESHOLD = 3, 0.5
#: Tokens whose order is pushed back: seen LOCAL times in a part and OFTEN times in all, at most MOST of them (9 MB).  They
#: change which groups are opened, never what is found.
LOCAL, OFTEN, MOST = 2, 4, 1_000_000
#: A token of more sets than this is handled in as many tasks as it has times so many.
HOT = 1_000_000
#: Prefix tokens that candidates must share (k above) are SHARED at least and a quarter of the needed overlap about, or all of it
#: where that is less.  More are more selective, and make for longer prefixes.  A set's id holds its k in the low CODES bits.
SHARED, CODES = 8, 16
#: Members, and tokens of them, that a task compares at once; larger groups come in parts, and each query meets every part.
GROUP, PART_TOKENS = 1024, 1 << 20
#: Likewise for the queries of a group, which come in blocks.
BLOCK, BLOCK_TOKENS = 4096, 1 << 22


def token_set(text: str | None, memo, n: int) -> np.ndarray:
    return np.unique(ngram_hashes(hashed(words_of(text), memo), n))


def set_id(tokens: np.ndarray, t: float) -> int:
    """Identity of a token set, signed for Spark; its low bits tell how many prefix tokens a partner must share."""
    k = shared_needed(len(tokens), t)
    code = k - 1 if k <= SHARED else k.bit_length() + SHARED - SHARED.bit_length() - 1
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes()) & ~(CODES - 1) | code).astype(np.int64))


def _k(name: str) -> str:
    """SQL for the k of a set by its id."""
    code = f"cast({name} & {CODES - 1} AS INT)"
    return f"if({code} < {SHARED}, {code} + 1, shiftleft({SHARED}, {code} - {SHARED - 1}))"


def size_class(size: np.ndarray | float) -> np.ndarray:
    """Eighths of octaves; exact powers of two are the only sizes that come near a border."""
    return np.floor(8 * np.log2(np.maximum(size, 1)) + 1e-11).astype(np.uint8)


def class_gap(t: float) -> int:
    """How many classes the lesser of two similar sets is below the other at most."""
    return math.ceil(-8 * math.log2(t) - 1e-11)


def partner_class(size: int, k: int, places: int, t: float) -> np.ndarray:
    """For each place of a prefix the greatest class of a partner that can have one of the first k common tokens there."""
    most = (1 + t) / t * (size - np.arange(places) + k) - size
    return size_class(np.minimum(most, size / t) + 1e-6)


def overlap_needed(size: int, t: float) -> int:
    """Least overlap of a set of this size with any set at Jaccard index t or more."""
    return max(1, math.ceil(t * size - 1e-9))


def shared_needed(size: int, t: float) -> int:
    """Prefix tokens that a set of this size shares with any partner that needs as many: 1 to SHARED, or a power of two."""
    need = overlap_needed(size, t)
    return min(SHARED, need) if need < 8 * SHARED else 1 << min(SHARED.bit_length() - 1 + CODES - SHARED, (need // 4).bit_length() - 1)


def prefix(tokens: np.ndarray, t: float, frequent: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The tokens of the prefix of a sorted set, in the order (level of frequent ones, hash)."""
    keep = len(tokens) - overlap_needed(len(tokens), t) + shared_needed(len(tokens), t)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        late = frequent[at] == tokens
        last = np.flatnonzero(late)
        tokens = np.concatenate([tokens[~late], tokens[last[np.argsort(level[at[last]], kind="stable")]]])
    return tokens[:keep]


def _texts(docs: DataFrame) -> DataFrame:
    return lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")


def frequent_tokens(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Sorted hashes of the most frequent tokens of the whole corpus, and the levels of their counts; of the hot ones, into how
    many tasks they go."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, seen = word_hashes(), [], 0

        def flush():
            token, times = np.unique(np.concatenate(held), return_counts=True)
            some = times >= LOCAL
            return pa.RecordBatch.from_arrays([pa.array(token[some].view(np.int64)), pa.array(times[some].astype(np.int64))], ["token", "times"])

        for part in slices(batches):
            words = [words_of(x) for x in part["text"]]
            for w in words:
                held.append(ngram_hashes(hashed(w, memo), n))
                seen += len(held[-1])
            if seen > 3_000_000:
                yield flush()
                held, seen = [], 0
        if held:
            yield flush()

    counted = _texts(docs).select("text").mapInArrow(count, "token long, times long")
    often = cut(counted.groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= OFTEN).withColumn("level", F.floor(4 * F.log2("times")).cast("int")))
    # the most frequent levels that stay within MOST tokens; no sort, and no task that gathers candidates of all others
    level, held = None, 0
    for r in sorted(often.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        held += r["count"]
        if held > MOST:
            break
        level = r["level"]
    if level is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), {}
    top = often.where(F.col("level") >= level)
    hot = {r["token"] % (1 << 64): -(-r["times"] // HOT) for r in top.where(F.col("times") > HOT).collect()}
    found = top.select("token", "level").toArrow()
    tokens, levels = found["token"].to_numpy().astype(np.int64).view(np.uint64), found["level"].to_numpy().astype(np.uint8)
    order = np.argsort(tokens)
    return tokens[order], levels[order], hot


#: One row for a shuffle partition, a residue of tokens and a part of the documents: sets, how many keys each has, the keys and what
#: partners they are for (the class of the set, then the greatest of each key); and sets, documents and numbers of tokens.
PACKED = "pid int, residue int, owners binary, counts binary, keys binary, spans binary, sets binary, docs binary, sizes binary"
#: Greatest partner class of hot tokens, whose holders are in several tasks and never told to suit no other.
ANY = 255


def _postings(docs: DataFrame, n: int, t: float, frequent: np.ndarray, level: np.ndarray, hot: dict[int, int], width: int) -> DataFrame:
    """PACKED rows of all prefix tokens with the sets that they are of, and of all sets with their documents."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, level, np.array(sorted(hot), np.uint64), np.array([hot[x] for x in sorted(hot)], np.uint64)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (late, level, hottest, tasks) = word_hashes(), shared.value
        tokens, upto, counts, sets, ids, sizes, held = [], [], [], [], [], [], 0

        def flush():
            # A token's residue and 32 other bits tell it from others.  Tokens that coincide bring a hopeless candidate now and then.
            sid, doc, long = np.array(sets, np.int64), np.array(ids, np.int64), np.array(sizes, np.int32)
            tok, top, of = np.concatenate(tokens), np.concatenate(upto), np.repeat(np.arange(len(sid)), np.array(counts))
            own = size_class(long)
            residue = (tok % np.uint64(width)).astype(np.int64)
            pid, key = residue.copy(), (tok >> np.uint64(32)).astype(np.uint32)
            if len(hottest):
                at = np.minimum(np.searchsorted(hottest, tok), len(hottest) - 1)
                i = np.flatnonzero(hottest[at] == tok)
                top[i] = ANY
                pid[i] = (pid[i] + (sid[of[i]].view(np.uint64) // np.uint64(CODES) % tasks[at[i]]).astype(np.int64)) % width
            order = np.lexsort((of, residue, pid))
            pid, residue, of, key, top = pid[order], residue[order], of[order], key[order], top[order]
            apart = np.append(True, (pid[1:] != pid[:-1]) | (residue[1:] != residue[:-1]))
            row = np.flatnonzero(apart)
            cell = np.flatnonzero(apart | np.append(True, of[1:] != of[:-1]))
            each, owner, own = np.diff(np.append(cell, len(pid))).astype(np.uint32), sid[of[cell]], own[of[cell]]
            ends, cells = np.append(row, len(pid)), np.append(np.searchsorted(cell, row), len(cell))
            none = np.zeros(0).tobytes()
            out = [(int(pid[r]), int(residue[r]), owner[cells[i] : cells[i + 1]].tobytes(), each[cells[i] : cells[i + 1]].tobytes(), key[ends[i] : ends[i + 1]].tobytes(), own[cells[i] : cells[i + 1]].tobytes() + top[ends[i] : ends[i + 1]].tobytes(), none, none, none) for i, r in enumerate(row)]
            home = (sid.view(np.uint64) // np.uint64(CODES) % np.uint64(width)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            home, sid, doc, long = home[order], sid[order], doc[order], long[order]
            at = np.append(np.flatnonzero(np.append(True, home[1:] != home[:-1])), len(home))
            out += [(int(home[a]), 0, none, none, none, none, sid[a:b].tobytes(), doc[a:b].tobytes(), long[a:b].tobytes()) for a, b in zip(at, at[1:])]
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], PACKED.replace(",", "").split()[::2])

        for part in slices(batches):
            for doc, text in zip(part["doc_id"], part["text"]):
                s = token_set(text, memo, n)
                if len(s):
                    p = prefix(s, t, late, level)
                    tokens.append(p), upto.append(partner_class(len(s), shared_needed(len(s), t), len(p), t)), counts.append(len(p)), sets.append(set_id(s, t)), ids.append(doc), sizes.append(len(s))
                    held += len(p)
            if held > 1_500_000:
                yield flush()
                tokens, upto, counts, sets, ids, sizes, held = [], [], [], [], [], [], 0
        if ids:
            yield flush()

    return _texts(docs).mapInArrow(emit, PACKED)


def _suited(tok: np.ndarray, own: np.ndarray, top: np.ndarray, gap: int) -> np.ndarray:
    """Which postings, sorted by token, have another of their token with a set of a size that they are for."""
    at = np.cumsum(np.append(0, tok[1:] != tok[:-1])) << 9
    sizes = np.sort(at + own)
    least, most = at + np.maximum(own.astype(np.int64) - gap, 0), at + top
    others = np.searchsorted(sizes, most, "right") - np.searchsorted(sizes, least) - (own <= top)
    return (others > 0) | (top == ANY)


def _sharing(t: float):
    """The step from PACKED rows to those of _shared."""
    gap = class_gap(t)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From one shuffle partition: (0, token, set, leader, class, top) for each token that several sets have, the leader
        being the least of them here, and (1, set, document, number of tokens)."""
        own, tok, span, top, sid, doc, long = [], [], [], [], [], [], []
        for b in batches:
            for residue, owners, counts, keys, spans, sets, ids, sizes in zip(*(b.column(i).to_pylist() for i in range(1, 9))):
                of, each, kinds = np.frombuffer(owners, np.int64), np.frombuffer(counts, np.uint32), np.frombuffer(spans, np.uint8)
                own.append(np.repeat(of, each)), span.append(np.repeat(kinds[: len(of)], each)), top.append(kinds[len(of) :])
                tok.append(np.frombuffer(keys, np.uint32).astype(np.int64) << 31 | residue)
                sid.append(np.frombuffer(sets, np.int64)), doc.append(np.frombuffer(ids, np.int64)), long.append(np.frombuffer(sizes, np.int32))
        if not tok:
            return

        def rows(kind, *columns):
            for at in range(0, len(columns[0]), 1_000_000):
                part = [x[at : at + 1_000_000] for x in columns]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16()]
                arrays = [pa.array(x.astype(k.to_pandas_dtype()), k) for x, k in zip(part, kinds)]
                arrays += [pa.nulls(len(part[0]), k) for k in kinds[len(part) :]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind, np.int32)), *arrays], ["kind", "a", "b", "c", "class", "top"])

        yield from rows(1, np.concatenate(sid), np.concatenate(doc), np.concatenate(long))
        del sid, doc, long
        tok, own, span, top = np.concatenate(tok), np.concatenate(own), np.concatenate(span), np.concatenate(top)
        order = np.argsort(tok, kind="stable")
        tok, own, span, top = tok[order], own[order], span[order], top[order]
        first = np.flatnonzero(np.append(True, tok[1:] != tok[:-1])) if len(tok) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(tok)))
        keep = np.repeat(times > 1, times) | (top == ANY)
        tok, own, span, top = tok[keep], own[keep], span[keep], top[keep]
        order = np.lexsort((own, tok))
        tok, own, span, top = tok[order], own[order], span[order], top[order]
        if len(tok):
            # each set once for a token: rows may repeat
            keep = np.append(True, (tok[1:] != tok[:-1]) | (own[1:] != own[:-1]))
            tok, own, span, top = tok[keep], own[keep], span[keep], top[keep]
            for _ in range(2):  # of two that have a token, one may be for the other and not the other way round
                keep = _suited(tok, span, top, gap) if len(tok) else np.zeros(0, bool)
                tok, own, span, top = tok[keep], own[keep], span[keep], top[keep]
        if len(tok):
            first = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
            yield from rows(0, tok, own, np.repeat(own[first], np.diff(np.append(first, len(tok)))), span, top)

    return shared


def _groups(posted: DataFrame) -> DataFrame:
    """(set, grp) of the sets that join another's group; all others have a group of their own name.  Chains of sets that join
    one another are followed four steps, which is enough for most and is not needed by any."""
    ties = posted.where("set <> leader").groupBy("set", "leader").agg(F.count(F.lit(1)).alias("times"))
    best = ties.where(f"times >= least({_k('set')}, {_k('leader')})").groupBy("set").agg(F.max(F.struct("times", F.expr("~leader").alias("l"))).alias("m"))
    groups = cut(best.select("set", F.expr("~m.l").alias("grp")))
    for _ in range(2):
        up = groups.select(F.col("set").alias("grp"), F.col("grp").alias("up"))
        groups = groups.join(up, "grp", "left").select("set", F.coalesce("up", "grp").alias("grp"))
    return cut(groups)


def _matrix(posted: DataFrame, groups: DataFrame, t: float) -> tuple[DataFrame, DataFrame]:
    """(cells, pivots): (set, g, own) where the overlap of a set with the row of group g, its own or a lesser one, reaches k,
    counting tokens of which a member that suits the set's size may be the holder; and (g, pivot), the member of g that has
    most of the tokens that are shared within it."""
    gap = class_gap(t)
    placed = posted.join(groups, "set", "left").select("token", "set", F.coalesce("grp", "set").alias("grp"), "class", "top").repartition("token")
    row = placed.groupBy("token", F.col("grp").alias("g")).agg(
        F.count(F.lit(1)).alias("holders"), F.min(F.expr(_k("set"))).alias("k"), F.min("class").alias("least"), F.max("class").alias("most"), F.max("top").alias("upto")
    )
    suits = f"least <= top AND most >= class - {gap} AND class <= upto AND class >= least - {gap}"
    hits = placed.join(row, "token").where(f"(g < grp OR g = grp AND holders > 1) AND {suits}")
    hits = hits.groupBy("set", "grp", "g").agg(F.count(F.lit(1)).alias("overlap"), F.min("k").alias("k"), F.sum("holders").alias("popular"))
    cells = cut(hits.where(f"overlap >= least({_k('set')}, k)").select("set", "g", F.expr("g = grp").alias("own"), "popular"))
    pivots = cells.where("own").groupBy("g").agg(F.max(F.struct("popular", "set")).alias("m")).select("g", F.col("m.set").alias("pivot"))
    return cells.drop("popular"), pivots


def open_group(members: list[tuple[int, int, bool, np.ndarray]], queries: list[tuple[int, int, bool, np.ndarray]], t: float) -> list[tuple[int, int, int]]:
    """(set, links, root) of the members and queries with a link among them: the number of documents of the sets that it is
    similar to, and one set for all that are so connected.

    Members are (set, number of documents, core, tokens) and queries (set, number of documents, own, tokens), own being whether
    the query is of this group.  Of such, a pair of sets that are both queries counts for the lesser as the member."""
    ids, weight = np.array([m[0] for m in members], np.int64), np.array([m[1] for m in members], np.int64)
    core, sizes = np.array([m[2] for m in members]), np.array([len(m[3]) for m in members])
    flat, of = np.concatenate([m[3] for m in members]), np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    union, starts = np.unique(flat, return_index=True)  # the group's row of the token-group matrix, over whole sets
    lengths = np.diff(np.append(starts, len(flat)))
    known = {s: i for i, s in enumerate(ids.tolist())}
    extra = {s: len(known) + i for i, s in enumerate(q[0] for q in queries if q[0] not in known)}
    name = np.concatenate([ids, np.array(list(extra), np.int64)])
    links, root = np.zeros(len(name), np.int64), name.copy()
    for q, many, own, s in queries:
        at = np.minimum(np.searchsorted(union, s), len(union) - 1)
        # the bound is the overlap with the others' tokens: those that a query in the group alone brought don't count
        hit = at[(union[at] == s) & (lengths[at] > (q in known))]
        if len(hit) < overlap_needed(len(s), t):
            continue
        n = lengths[hit]
        picks = np.repeat(starts[hit] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        common = np.bincount(of[picks], minlength=len(ids))
        alike = common >= t * (sizes + len(s) - common) - 1e-9
        if own:
            alike &= core | (ids < q)
            if q in known:
                alike[known[q]] = False
        found = np.flatnonzero(alike)
        if len(found):
            me = known[q] if q in known else extra[q]
            links[me] += weight[found].sum()
            links[found] += many
            joined = np.unique(np.append(root[found], root[me]))
            root[np.isin(root, joined)] = joined[0]
    return [(int(name[i]), int(links[i]), int(root[i])) for i in np.flatnonzero(links)]


def _core(rows: DataFrame, n: int, t: float) -> DataFrame:
    """(set,) of the rows (g, part, first, set, text), in which each part has its pivot first, that are within (1 - t) / 2 of it."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, key, pivot = word_hashes(), None, None
        for part in slices(batches, 64):
            out = []
            for g, p, first, s, text in zip(part["g"], part["part"], part["first"], part["set"], part["text"]):
                tokens = token_set(text, memo, n)
                if set_id(tokens, t) != s:
                    continue
                if first:
                    key, pivot = (g, p), tokens
                elif key == (g, p):
                    common = len(np.intersect1d(pivot, tokens, assume_unique=True))
                    if common >= (1 + t) / 2 * (len(pivot) + len(tokens) - common) + 1e-6:
                        out.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["set"])

    return rows.mapInArrow(near, "set long")


def set_links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(linked, sets): (set, links, root), with rows of one set to be added up and roots to be connected; and (set, first,
    weight, size), each set's least document, number of documents and number of tokens, beside (set, doc_id) in members."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    width, (frequent, level, hot) = shuffle_width(docs), frequent_tokens(docs, n)
    packed = _postings(docs, n, threshold, frequent, level, hot, width).repartitionById(width, "pid")
    posted = table(packed.mapInArrow(_sharing(threshold), "kind int, a long, b long, c long, class short, top short"))
    members = posted.where("kind = 1").select(F.col("a").alias("set"), F.col("b").alias("doc_id"), F.col("c").cast("int").alias("size")).distinct()
    posted = posted.where("kind = 0").select(F.col("a").alias("token"), F.col("b").alias("set"), F.col("c").alias("leader"), "class", "top")
    # A partner has t of the size at least, and so this k at least; a set with fewer tokens that any other has, has no partner.
    posted = posted.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("set"))).where(f"held >= pow(2, floor(log2({threshold} * {_k('set')})))").drop("held")
    groups = _groups(posted)
    cells, pivots = _matrix(posted, groups, threshold)
    sets = members.groupBy("set").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("weight"), F.max("size").alias("size"))

    # the members of every group that some query opens: those that joined it, and its name unless that joined another
    opened = cells.select("g").distinct()
    inside = groups.withColumnRenamed("grp", "g").join(opened, "g", "left_semi").select("set", "g")
    alone = opened.join(groups.select(F.col("set").alias("g")), "g", "left_anti").select(F.col("g").alias("set"), "g")
    inside = inside.union(alone)
    involved = cells.select("set").union(inside.select("set")).distinct()
    info = cut(sets.join(involved, "set"))

    def split(rows: DataFrame, most: int, tokens: int, name: str) -> DataFrame:
        sized = rows.join(info.select("set", "size"), "set").groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("s"))
        return sized.select("g", F.greatest(F.ceil(F.col("m") / most), F.ceil(F.col("s") / tokens)).cast("int").alias(name))

    texts = _texts(docs)

    def with_text(rows: DataFrame) -> DataFrame:
        """rows with the text of their set, which is that of its first document; other texts of that doc_id are told by the hash."""
        rows = rows.join(info.select("set", F.col("first").alias("_doc")), "set")
        return texts.join(small_or_shuffled(cut(rows), 200_000), texts["doc_id"] == F.col("_doc")).drop("doc_id", "_doc")

    parts = split(inside, GROUP, PART_TOKENS, "parts")
    large = cut(parts.where("parts > 1").join(pivots, "g"))
    core = None
    if not large.isEmpty():
        home = F.expr("cast(pmod(xxhash64(set), parts) AS int)").alias("part")
        rows = inside.join(large, "g").where("set <> pivot").select("g", home, F.lit(False).alias("first"), "set")
        firsts = large.select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("first"), F.col("pivot").alias("set"))
        laid = with_text(rows.union(firsts)).repartition(width, "g", "part").sortWithinPartitions("g", "part", F.desc("first"), "set")
        core = _core(laid, n, threshold).join(large.select(F.col("pivot").alias("set")), "set", "full").select("set").distinct()
        core = cut(core.join(inside, "set").select("set", "g"))
    inside = inside.join(core.withColumn("core", F.lit(True)), ["set", "g"], "left") if core is not None else inside.withColumn("core", F.lit(None).cast("boolean"))
    inside = inside.select("set", "g", F.coalesce("core", F.lit(False)).alias("core"))
    asked = cells if core is None else cells.join(core.withColumn("own", F.lit(True)), ["set", "g", "own"], "left_anti")
    blocks = split(asked, BLOCK, BLOCK_TOKENS, "blocks")
    shape = cut(parts.join(blocks, "g"))
    all_parts, all_blocks = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    home, block = F.expr("cast(pmod(xxhash64(set), parts) AS int)"), F.expr("cast(pmod(xxhash64(set, 1), blocks) AS int)")
    rows = inside.join(shape, "g").select("g", home.alias("part"), all_blocks.alias("block"), F.lit(True).alias("member"), "set", F.col("core").alias("flag"))
    rows = rows.union(asked.join(shape, "g").select("g", all_parts.alias("part"), block.alias("block"), F.lit(False).alias("member"), "set", F.col("own").alias("flag")))
    laid = with_text(rows.join(info.select("set", "weight"), "set"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, key, inside, asking, last = word_hashes(), None, [], [], None

        def result():
            out = open_group(inside, asking, threshold) if inside else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["set", "links", "root"])

        for part in slices(batches, 64):
            for g, p, b, member, s, flag, weight, text in zip(*(part[c] for c in ("g", "part", "block", "member", "set", "flag", "weight", "text"))):
                if (g, p, b) != key:
                    if asking:
                        yield result()
                    key, inside, asking, last = (g, p, b), [], [], None
                if (member, s) == last:
                    continue
                tokens = token_set(text, memo, n)
                if set_id(tokens, threshold) == s:
                    last = (member, s)
                    (inside if member else asking).append((s, weight, flag, tokens))  # members come first
        if asking:
            yield result()

    ordered = laid.repartition(width, "g", "part", "block").sortWithinPartitions("g", "part", "block", F.desc("member"), "set")
    linked = ordered.mapInArrow(verify, "set long, links long, root long")
    if core is not None:  # the members of a core are all linked to one another
        whole = core.join(info.select("set", "weight"), "set")
        total = whole.groupBy("g").agg(F.sum("weight").alias("total"), F.min("set").alias("root"))
        linked = linked.union(whole.join(total, "g").select("set", (F.col("total") - F.col("weight")).alias("links"), "root").where("links > 0"))
    return cut(linked), cut(sets.where("weight > 1").union(info).distinct()), members


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, class_id, n_links) of every document that is similar to another.

    n_links is the number of other documents at the threshold, copies included; class_id is the least doc_id of all that the
    document is connected with through such links.  Documents without a link are a class by themselves and have no row.
    """
    linked, sets, members = set_links(docs, n, threshold)
    first = sets.select("set", "first")
    edges = linked.where("set <> root").select("set", "root").distinct()
    edges = edges.join(first.withColumnRenamed("first", "a"), "set").join(first.select(F.col("set").alias("root"), F.col("first").alias("b")), "root")
    label = components(edges.select("a", "b").where("a <> b"))
    links = linked.groupBy("set").agg(F.sum("links").alias("links"))
    known = sets.join(links, "set", "left").where("weight > 1 OR links > 0").join(label.withColumnRenamed("doc_id", "first"), "first", "left")
    known = known.select("set", F.coalesce("root", "first").alias("class_id"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rows = members.join(known, "set").select("doc_id", "class_id", "n_links")
    return rows.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, root): the least doc_id that each doc_id of edges (a, b) is connected with, by itself or through others."""
    edges = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = cut(edges.groupBy(F.col("a").alias("doc_id")).agg(F.min("b").alias("m")).select("doc_id", F.least("doc_id", "m").alias("root")))
    while True:
        over = edges.join(label.select(F.col("doc_id").alias("b"), F.col("root").alias("near")), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("near").alias("near"))
        step = label.join(over, "doc_id").select("doc_id", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = label.select(F.col("doc_id").alias("root"), F.col("root").alias("far"))
        step = cut(step.join(jump, "root", "left").select("doc_id", F.least("root", "far").alias("root"), "old"))
        done = step.where("root <> old").isEmpty()
        label = step.drop("old")
        if done:
            return label


def drop_near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that are connected, by similar pairs, with a document of lesser doc_id.

    Rows that repeat a doc_id stand or fall together.  Null and empty texts and rows without doc_id stay.
    """
    gone = small_or_shuffled(cut(jaccard_join(docs, n, threshold).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone"))))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
