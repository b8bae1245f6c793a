"""Spelling variants: words one edit apart, found by scanning sorted lists.

``vocabulary`` counts words.  ``links`` finds every pair of words that differ by
one inserted, deleted or replaced code point.  Two such words agree before and
after the edit, so a word is dealt to lists keyed by what an edit leaves
unchanged: the list (n, lo, hi) of a shorter word's length ``n`` holds words that
agree before ``lo`` and in the last ``n - hi`` code points.  A pair belongs to the
one list whose ``lo .. hi`` holds the end of its common prefix.  Lists begin with
halves of the word; a list of more than ``LIST_WORDS`` words is dealt anew by the
halves of its ``lo .. hi``, down to one code point, so no list grows with the
table, and nothing is left out.

Each list is sorted and scanned once for every word in it, from the word on: the
rows of the edit matrix, a band of three cells, are kept by depth, the common
prefix (LCP) with the next word of the list says how many of them still hold, and
once all cells of a row are above one edit, the scan leaves out every word
that shares this prefix.  All scans of a batch take their steps together.

Defined results: a null text has no words; an empty vocabulary gives no rows; a
null id counts as the text "" in the digest that deletes letters; repeated rows
count again; words are compared by code points; among the nearest words of
equal count the first in code-point order is the form; other columns are ignored."""
from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadforge.llm.tables import materialize, shuffled

MIN_LENGTH, MIN_COUNT, RATIO, ONE_IN = 7, 2, 10, 31
#: a list of more words (of eight code points between lo and hi, of fewer if there are more) is dealt anew
LIST_WORDS = 2_000
#: cells of the code-point matrix that a task holds at once
CELLS = 1 << 20

LIST_SCHEMA = "word string, n_near bigint, best_n bigint, best string"


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, one_in: int = ONE_IN) -> DataFrame:
    """``word, n``: runs of letters after A-Z are lower-cased.  A run whose
    digest (crc32 of ``<doc_id>:<run>``) is divisible by ``one_in`` loses the
    code point at the digest modulo its length."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # runs that are too short at first stay so
    runs = F.expr(f"regexp_extract_all(text, '[A-Za-z\\u00C0-\\u00FF]{{{min_length},}}', 0)")
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    words = words.select("id", F.translate("run", upper, lower).alias("run"))
    digest = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    words = words.select("run", digest.alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % one_in == 0, shorter).otherwise(F.col("run"))
    return (words.select(word.alias("word")).where(F.char_length("word") >= min_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


def _dealt(words: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Rows of the lists (n, lo, hi): what all words of a list share, and what
    stands between."""
    end = F.col("len") - F.col("n") + F.col("hi")           # where the shared end begins: one later in a longer word
    return (words.withColumns({"lo": lo, "hi": hi})
            .withColumns({"head": F.substring("word", F.lit(1), F.col("lo")),
                          "mid": F.substring("word", F.col("lo") + 1, end - F.col("lo")),
                          "tail": F.substring("word", end + 1, F.col("len"))})
            .select("word", "count", "len", *KEY, "mid"))


KEY = ["n", "lo", "hi", "head", "tail"]


def lists(words: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """The words dealt to lists; lists of one word are left out."""
    # a word is the shorter one of its pairs, or the longer one
    both = (words.select("word", F.col("n").alias("count"), F.char_length("word").alias("len"))
            .withColumn("n", F.explode(F.array("len", F.col("len") - 1))).where("n > 0"))
    half = F.floor(F.col("n") / 2).cast("int")
    todo = _halves(both, F.lit(0), half, F.col("n"))
    done = None
    while True:
        sizes = todo.groupBy(*KEY).agg(F.count("*").alias("size"), F.min("len").alias("shortest")).where("size > 1 AND shortest = n")
        free = F.col("hi") - F.col("lo")
        sized = materialize(todo.join(shuffled(sizes.drop("shortest")), KEY).withColumn(
            "large", (F.col("size") * F.greatest(free, F.lit(8)) > 8 * list_words) & (free > 1)).drop("size"))
        part = sized.where("NOT large").select("count", *KEY, "mid")
        done = part if done is None else done.unionByName(part)
        over = sized.where("large").select("word", "count", "len", "n", "lo", "hi")
        if over.isEmpty():
            return done
        middle = F.floor((F.col("from") + F.col("to")) / 2).cast("int")
        over = over.withColumnsRenamed({"lo": "from", "hi": "to"})
        todo = _halves(over, F.col("from"), middle, F.col("to"))


def _halves(words: DataFrame, lo: Column, middle: Column, hi: Column) -> DataFrame:
    part = F.explode(F.array(F.struct(lo.alias("a"), middle.alias("b")), F.struct(middle.alias("a"), hi.alias("b"))))
    parts = words.withColumn("part", part)
    return _dealt(parts, F.col("part.a"), F.col("part.b")).where("lo < hi")


def scan(codes: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows one edit apart in each sorted list.

    ``codes``: code points by row, sorted within a list, -1 beyond a row's
    ``length``; ``group``: list numbers, ascending."""
    rows, width = codes.shape
    same = np.r_[False, group[1:] == group[:-1]]
    differ = np.ones((rows, width + 1), bool)
    differ[1:, :width] = codes[1:] != codes[:-1]
    lcp = np.minimum(differ.argmax(1), np.r_[length[:1], np.minimum(length[1:], length[:-1])])
    lcp[~same] = 0
    # the next row of the list whose LCP with its predecessor is below d, found by walking from smaller LCP to smaller LCP
    below = np.full(rows + 1, rows, np.int64)
    stack: list[int] = []
    low = np.where(same, lcp, -1).tolist() + [-2]
    for i, v in enumerate(low):
        while stack and low[stack[-1]] > v:
            below[stack.pop()] = i
        stack.append(i)
    last = np.searchsorted(group, group, side="right")
    low = np.array(low)

    query = np.arange(rows)
    at = query + 1                                          # the word that each scan compares next
    live = at < last[query]
    query, at = query[live], at[live]
    depth = lcp[at]                                         # the first word shares this much with the scanning word itself
    # band[q, d, k]: edits between the first d code points of the list's word and the first d - 1 + k of the query, 2 for more
    band = np.full((len(query), width + 1, 3), 2, np.int8)
    band[:, :, 1], band[:, :, 2] = 0, 1                     # along the query itself
    band[:, 1:, 0] = 1
    slot = np.arange(len(query))
    left, right = [], []
    padded = np.concatenate([codes, np.full((rows, 2), -2, codes.dtype)], 1)
    while len(slot):
        finished = depth >= length[at]
        # compare the next code point of the words that are not at their end
        go = np.flatnonzero(~finished)
        if len(go):
            s, q, w, d = slot[go], query[go], at[go], depth[go]
            c = codes[w, d]
            b = band[s, d].astype(np.int8)
            mine = [padded[q, np.maximum(d - 1 + k, 0)] for k in range(3)]     # at d = 0 the first cell has no column: it is 2 anyway
            inside = [d + k <= length[q] for k in range(3)]             # row d + 1, column d + k
            n0 = np.where(inside[0], np.minimum(b[:, 0] + (mine[0] != c), b[:, 1] + 1), 2)
            n1 = np.where(inside[1], np.minimum(np.minimum(b[:, 1] + (mine[1] != c), b[:, 2] + 1), n0 + 1), 2)
            n2 = np.where(inside[2], np.minimum(b[:, 2] + (mine[2] != c), n1 + 1), 2)
            row = np.minimum(np.stack([n0, n1, n2], 1), 2).astype(np.int8)
            band[s, d + 1] = row
            depth[go] = d + 1
            dead = row.min(1) > 1
        else:
            dead = np.zeros(0, bool)
        # at a word's end the cell of both lengths is the distance
        end = np.flatnonzero(finished)
        k = length[query[end]] - length[at[end]] + 1
        ok = (k >= 0) & (k <= 2)
        e = end[ok]
        e = e[band[slot[e], length[at[e]], k[ok]] == 1]
        left.append(query[e])
        right.append(at[e])
        # the next word: after a finished one its neighbour, after a dead prefix the first word that does not share it
        move = np.zeros(len(slot), bool)
        move[end] = True
        to, shared = at.copy(), depth.copy()
        to[end] = at[end] + 1
        if len(go) and dead.any():
            g = go[dead]
            move[g] = True
            j = at[g] + 1
            stop = last[query[g]]
            while True:
                more = (j < stop) & (low[np.minimum(j, rows)] >= depth[g])
                if not more.any():
                    break
                j[more] = below[j[more]]
            to[g] = j
        m = np.flatnonzero(move)
        keep = np.ones(len(slot), bool)
        keep[m] = to[m] < last[query[m]]
        at = to
        m = m[keep[m]]
        # rows up to the LCP still hold; over a jump the LCP is the smallest one passed, which is the one jumped to
        shared[m] = np.minimum(depth[m], lcp[at[m]])
        depth = shared
        slot, query, at, depth = slot[keep], query[keep], at[keep], depth[keep]
    return np.concatenate(left) if left else np.empty(0, np.int64), np.concatenate(right) if right else np.empty(0, np.int64)


def _near_in_lists(batch: list[tuple]) -> pa.RecordBatch:
    """``batch``: (list number, n, lo, hi, head, mid, tail, count) rows of whole
    lists, sorted by mid.  One row per word and list: how many near words the
    list has and the one of the largest count."""
    number, n, lo, hi, head, mid, tail, count = zip(*batch)
    group, n, lo, hi, count = (np.array(x, np.int64) for x in (number, n, lo, hi, count))
    size = np.fromiter(map(len, mid), np.int64, len(mid))
    length = size + lo + (n - hi)
    codes = np.full((len(batch), int(size.max())), -1, np.int32)
    codes[np.arange(codes.shape[1])[None, :] < size[:, None]] = np.frombuffer("".join(mid).encode("utf-32-le"), np.uint32)
    a, b = scan(codes, size, group)
    # this list's own pairs: the shorter word has n code points, and the common prefix ends within lo .. hi
    differ = codes[a] != codes[b]
    prefix = lo[a] + differ.argmax(1)
    own = (np.minimum(length[a], length[b]) == n[a]) & ((prefix < hi[a]) | (hi[a] == n[a]))
    a, b = a[own], b[own]
    me, other = np.concatenate([a, b]), np.concatenate([b, a])
    used = np.unique(me)
    word = {i: head[i] + mid[i] + tail[i] for i in used.tolist()}
    rank = np.zeros(len(batch), np.int64)
    rank[sorted(word, key=word.get)] = np.arange(len(word))
    order = np.lexsort((rank[other], -count[other], me))
    me, other = me[order], other[order]
    first = np.flatnonzero(np.r_[True, me[1:] != me[:-1]]) if len(me) else np.empty(0, np.int64)
    near = np.diff(np.r_[first, len(me)])
    return pa.RecordBatch.from_arrays([pa.array([word[i] for i in me[first].tolist()], pa.string()), pa.array(near, pa.int64()),
                                       pa.array(count[other[first]], pa.int64()), pa.array([word[i] for i in other[first].tolist()], pa.string())],
                                      schema=pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())]))


def near(words: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """``word, n_near, best_n, best`` of every word with a near word."""
    dealt = lists(words, list_words)
    # the key of a list as one digest for the deal; the rows of a list are told apart by the key itself
    dealt = dealt.select(F.xxhash64(*KEY).alias("deal"), *KEY, "mid", "count")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        widest, number, key = 0, 0, None
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(1, 8)]
            for n, lo, hi, head, tail, mid, count in zip(*cols):
                if key != (n, lo, hi, head, tail):
                    key = n, lo, hi, head, tail
                    number += 1
                    if len(rows) * widest > CELLS:
                        yield _near_in_lists(rows)
                        rows, widest = [], 0
                rows.append((number, n, lo, hi, head, mid, tail, count))
                widest = max(widest, hi - lo + 2)
        if rows:
            yield _near_in_lists(rows)

    found = dealt.repartition("deal").sortWithinPartitions("n", "lo", "hi", "deal", "head", "tail", "mid").mapInArrow(run, LIST_SCHEMA)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of all words that have a form.  A form is at least ten
    times as frequent, so the number of rounds is the logarithm of the largest
    count."""
    step = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        moved = materialize(at.join(shuffled(step), "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO,
             one_in: int = ONE_IN, list_words: int = LIST_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the whole vocabulary."""
    words = materialize(vocabulary(docs, min_length, min_count, one_in))
    found = near(words, list_words)
    form = F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))
    joined = materialize(words.join(shuffled(found), "word", "left").select(
        "word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(form.isNotNull(), F.col("best_n")).alias("form_n")))
    roots = _roots(materialize(joined.where("form IS NOT NULL").select("word", "form")))
    return joined.join(shuffled(roots), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
