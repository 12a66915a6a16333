"""Deduplication against plain versions of the contracts."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import jaccard_join, line_dedup, sql, suffix_dedup, window_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BIG = (1 << 63) - 1


def rows(df):
    return [(BIG if r.doc_id is None else r.doc_id, r.text or "") for r in df.collect()]


def plain_spans(docs):
    first = {}
    for i, t in docs:
        b = t.encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], BIG), i)
    out = []
    for i, t in docs:
        b = t.encode()
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p] += 1
                gone[p + 50] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).reshape(-1, 2)
        out.append((i, len(b), tuple(map(tuple, edges.tolist())), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("hot", "chunk"), [(1 << 16, 1 << 19), (2, 3000)])
def test_suffix_dedup(documents, monkeypatch, hot, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    got = suffix_dedup.spans(documents, hot=hot).collect()
    assert sorted((r.doc, r.n_bytes, tuple((s.start, s.end) for s in r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got) == plain_spans(rows(documents))


def test_hot_anchors_are_counted_by_places():
    once, often, several = ([np.array(x, np.uint64) for x in y] for y in ([[1, 2], [1]], [[3], []], [[3, 2], []]))
    common, busy = suffix_dedup.common_and_hot(once, often, several, [np.array([70, 9], np.uint32), np.zeros(0, np.uint32)], 50)
    # 3 is in one blob only, with 70 places
    assert common.tolist() == [1, 3] and busy.tolist() == [3]


def test_contexts_of_one_anchor_are_split_by_string(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    rng = np.random.default_rng(4)
    line = rng.integers(97, 123, 55)
    size = rng.integers(50, 114, 80)
    parts = [np.concatenate([line, rng.integers(97, 99, 113)])[:n].astype(np.uint8) for n in size]
    data, off, owner = np.concatenate(parts), np.concatenate([[0], np.cumsum(size)]), rng.integers(0, 1000, 80)
    whole, split = (f(data, off, owner) for f in (suffix_dedup.smallest_owner, suffix_dedup.by_string))
    assert all((x == y).all() for x, y in zip(whole, split, strict=True))


def test_only_strings_with_another_place_are_sorted(monkeypatch):
    rng, sorted_, plain = np.random.default_rng(7), [], suffix_dedup.smallest_owner
    line = rng.integers(97, 123, 70)
    parts = [rng.integers(97, 123, 110) for _ in range(60)] + [np.concatenate([rng.integers(97, 123, n), line[: 70 - n]]) for n in range(20)] + [line[:49], line[:50], line]
    size = np.array([len(x) for x in parts])
    data, off, owner = np.concatenate(parts).astype(np.uint8), np.concatenate([[0], np.cumsum(size)]), rng.integers(0, 1000, len(parts))
    want = plain(data, off, owner)
    monkeypatch.setattr(suffix_dedup, "smallest_owner", lambda d, o, w: sorted_.append(len(d)) or plain(d, o, w))
    got = suffix_dedup.repeated_owner(data, off, owner)
    assert all((x == y).all() for x, y in zip(got, want, strict=True))
    assert 0 < sum(sorted_) < len(data) / 4


def test_anchors_travel_in_a_row_for_each_bucket():
    """Rows grew with buckets times homes of a task, that is with the square of the text."""
    rng = np.random.default_rng(9)
    h, home, places = rng.integers(0, 3000, 9000).astype(np.uint64), rng.integers(0, 70, 9000), rng.integers(1, 3, 9000)
    rows, got, more = suffix_dedup.seen_rows(h, home, places, 50), Counter(), Counter()
    assert len(rows) == 50
    for bucket, homes, n_once, n_often, once, often, several, counts in rows:
        assert all((suffix_dedup.unsix(x) % np.uint64(50) == bucket).all() for x in (once, often, several))
        for blob, n, times in ((once, n_once, 1), (often, n_often, 2)):
            at = np.repeat(np.frombuffer(homes, np.int32), np.frombuffer(n, np.int32))
            got.update({k: times for k in zip(suffix_dedup.unsix(blob).tolist(), at.tolist(), strict=True)})
        for x, n in zip(suffix_dedup.unsix(several).tolist(), np.frombuffer(counts, np.uint32).tolist(), strict=True):
            more[x] += n
    assert got == Counter({x: min(n, 2) for x, n in Counter(zip(h.tolist(), home.tolist(), strict=True)).items()})
    total = Counter()
    for x, at, n in zip(h.tolist(), home.tolist(), places.tolist(), strict=True):
        total[x, at] += n
    assert more == sum((Counter({x: n}) for (x, _), n in total.items() if n > 1), Counter())


def test_suffix_ranks_order_prefixes():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = rng.integers(1, 3, rng.integers(1, 150))
        need = int(rng.choice([3, 4, 9, 10, 27, 50]))
        r = suffix_dedup.suffix_ranks(s, need)
        assert [tuple(s[i : i + need]) for i in np.argsort(r, kind="stable")] == sorted(tuple(s[i : i + need]) for i in range(len(s)))


def plain_components(docs, percent=80):
    sets = []
    for _, t in docs:
        w = WORD.findall(t.translate(LOW))
        sets.append(frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), BIG), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True)))


@pytest.mark.parametrize("block", [1 << 23, 400])
def test_jaccard_join(documents, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    got = [(BIG if r.doc is None else r.doc, r.n, BIG if r.component is None else r.component) for r in jaccard_join.classes(documents).collect()]
    assert sorted(got) == plain_components(rows(documents))


def test_jaccard_keep_first(documents):
    kept = jaccard_join.keep_first(documents)
    assert kept.columns == documents.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {d for d, _, c in plain_components(rows(documents)) if d == c}
    # the null id is a copy
    assert None not in ids and set(ids) >= want - {BIG} and 0 in ids and 52 not in ids


def test_jaccard_join_through_a_null_id(spark):
    """A row without an id links its neighbours, and rows that have none keep one of their group."""
    base = [f"w{k}" for k in range(104)]
    one = [*base[:50], "x", *base[51:]]
    two = [*base[:20], "y", *one[21:80], "z", *one[81:]]
    rows_ = [(1, " ".join(base)), (None, " ".join(one)), (3, " ".join(two)), (None, "only here " * 4), (None, "only here " * 4), (None, " "), (None, None), (None, "ONLY here " * 4)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    got = jaccard_join.classes(docs).collect()
    assert sorted(str((r.doc, r.n, r.component)) for r in got) == sorted(map(str, [(1, 100, 1), (None, 100, 1), (3, 100, 1)] + [(None, 2 if "here" in (t or "") else 0, None) for _, t in rows_[3:]]))
    kept = [(r.doc_id, r.text) for r in jaccard_join.keep_first(docs).collect()]
    assert (1, rows_[0][1]) in kept and len(kept) == 4 and (None, None) in kept and (None, " ") in kept


def test_tree_bound_loses_no_pair():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 1 << 63, rng.integers(5, 80), dtype=np.uint64)) for _ in range(60)]
    sets = base + [np.unique(np.concatenate([b[: int(len(b) * rng.uniform(0.7, 1))], rng.integers(0, 1 << 63, 3, dtype=np.uint64)])) for b in base for _ in range(3)]
    counts, size = jaccard_join._counts(sets), np.array([len(s) for s in sets])
    tree, alive = jaccard_join.Tree(counts, size), np.ones(len(sets), bool)
    for i, s in enumerate(sets):
        found = set(tree.search(counts[i], size[i], 0.8, alive).tolist())
        assert all(j in found for j, o in enumerate(sets) if jaccard_join._linked(s, o, 80))


def plain_lines(docs, least):
    def near(a, b):
        if a == b:
            return True
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    def order(t):
        return int(hashlib.md5(t.encode()).hexdigest()[:15], 16)

    every = [(d, order(t), k, x) for d, t in set(docs) for k, x in enumerate(t.split("\n")) if any(c > " " for c in x)]
    gone = {}
    for *place, x in every:
        if any(at < place and (x == y or min(len(x), len(y)) >= least and near(x, y)) for *at, y in every):
            gone.setdefault((place[0], place[1]), set()).add(place[2])
    return {d: sorted(x) for d, x in gone.items()}


def plain_left(docs, least):
    """(id, text) of the rows that stay: what a row loses is its own, whoever shares its id."""
    gone, out = plain_lines([(BIG if d is None else d, t or "") for d, t in docs], least), []
    for d, t in docs:
        own = gone.get((BIG if d is None else d, int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)))
        left = t if own is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in own)
        if own is None or any(c > " " for c in left):
            out.append((d, left))
    return sorted(out, key=str)


def _check_lines(df, docs):
    assert {(r.doc, r.row): r.gone for r in line_dedup.removed_lines(df).collect()} == plain_lines([(BIG if d is None else d, t or "") for d, t in docs], line_dedup.MIN_CHARS)
    assert sorted(((r.doc_id, r.text) for r in line_dedup.dedup(df).collect()), key=str) == plain_left(docs, line_dedup.MIN_CHARS)


def test_line_dedup(spark):
    lines = ["the quick brown fox jumps over", "the quick brown fox jumps ovre", "the quick brown fox jumps ove", "the quick brown fox jumps overs", "the quick brown fux jumps over", "short", "ünïcödé lines count by character", "ünïcödé lines count by charactér", "x the quick brown fox jumps over"]
    docs = [(4, "\n".join([lines[0], "short", lines[6]])), (1, "\n".join([lines[1], "short"])), (2, "\n".join(lines)), (3, lines[4]), (3, lines[4]), (7, None), (8, ""), (None, lines[8]), (9, "\n".join([lines[8]] * 3)), (10, "shart\n\n \nshort"), (11, "short\n\n\nshort\n\t"), (12, "\n\n")]
    _check_lines(spark.createDataFrame(docs, "doc_id long, text string"), docs)


def test_lines_of_rows_that_share_an_id_stay(spark, tmp_path):
    """What one row loses is never cut from another with the same id or none."""
    line = [f"a line of its own: {hashlib.md5(bytes([k])).hexdigest()}" for k in range(60)]

    def text(*k):
        return "\n".join(line[i] for i in k)

    docs = [(1, text(0, 1, 2)), (None, text(10, 1, 12)), (None, text(20, 21, 22)), (5, text(30, 2)), (5, text(40, 41)), (5, text(41, 43)), (5, text(41, 43)), (None, text(22, 51))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    _check_lines(df, docs)
    kept = " ".join(r.text for r in line_dedup.dedup(df).collect())
    assert all(x in kept for _, t in docs for x in t.split("\n"))
    # the registered query and its SQL on the same rows
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted((str(r.doc_id), r.n_lines, r.n_removed, r.removed) for r in line_dedup.op9_line_dedup(spark, str(tmp_path)).collect())
    assert got == sorted((str(a), b, c, d) for a, b, c, d in con.execute(sql.OP9).fetchall())


def test_line_dedup_of_a_corpus(documents):
    _check_lines(documents, [(r.doc_id, r.text) for r in documents.collect()])


def test_substring_dedup_finds_repeats_and_nothing_else(documents):
    out = window_dedup.passages(documents).collect()
    assert len(out) == documents.count()
    docs = rows(documents)
    seen = {}
    for d, t in docs:
        w = WORD.findall(t.translate(LOW))
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), set()).add(d)
    repeats = {d for d, t in docs for w in [WORD.findall(t.translate(LOW))] if any(min(seen[tuple(w[k : k + 50])]) < d for k in range(len(w) - 49))}
    found = {r.doc for r in out if r.sources}
    assert repeats <= found
    # everything else that is found is a near copy of one of the first documents
    assert all(40 <= d < 60 or d == BIG for d in found)
    assert window_dedup.classes(documents).where(F.col("doc") == 55).first()["class"] in range(56)


def test_substring_dedup_beyond_the_first_owner(spark):
    """Repeats of lines that stood in different documents before, and copies of a copy that is unlike the first."""
    rng = np.random.default_rng(5)
    texts, pairs = [], []
    for k in range(25):
        lines = [[f"k{k}l{i}w{j}" for j in range(10)] for i in range(6)]
        texts += [" ".join([f"a{k}x{i}y{j}" for j in range(30)] + line) for i, line in enumerate(lines)]
        passage = " ".join(w for line in lines for w in line)
        texts += [f"{' '.join(f'{side}{k}z{j}' for j in range(40))} {passage}" for side in "bc"]
        pairs.append((len(texts) - 2, len(texts) - 1))
    for k in range(25):
        a = [f"chain{k}w{j}" for j in range(50)]
        b = a[:8] + ["one"] + a[9:]
        c = b[:30] + ["two"] + b[31:]
        texts += [" ".join(x) for x in (a, b, c)]
        pairs.append((len(texts) - 2, len(texts) - 1))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc: r for r in window_dedup.passages(docs).collect()}
    assert all(b in found[c].sources for b, c in pairs[:25])
    assert all(sum(s.end - s.start for s in found[c].spans) >= 60 for _, c in pairs[:25])
    assert sum(b in found[c].sources for b, c in pairs[25:]) >= 24


def plain_passages(docs):
    """For each row: {earlier id: first words of its 50-word passages similar to a stretch of 50 to 61 words there}."""
    grams = [(d, [tuple(w[k : k + 5]) for k in range(len(w) - 4)]) for d, t in docs for w in [WORD.findall(t.translate(LOW))]]
    holders = {}
    for x, (_, g) in enumerate(grams):
        for s in set(g):
            holders.setdefault(s, set()).add(x)
    out = []
    for d, g in grams:
        own, rivals = {}, Counter(x for s in set(g) for x in holders[s] if grams[x][0] < d)
        for x in (x for x, n in rivals.items() if n >= 30):
            e, h = grams[x]
            for i in range(len(g) - 45):
                a = set(g[i : i + 46])
                if any(5 * len(a & b) >= 4 * len(a | b) for n in range(46, 58) for j in range(len(h) - n + 1) for b in [set(h[j : j + n])] if 5 * len(a) >= 4 * n or len(b) < n):
                    own.setdefault(e, set()).add(i)
        out.append(own)
    return out


def _found(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc: r for r in window_dedup.passages(df, **options).collect()}


@pytest.mark.parametrize("hot", [1 << 14, 1])
def test_substring_dedup_recall(spark, hot):
    """A text that almost has a passage must not hide it: exact repeats are found whole, near ones nine times in ten."""
    rng, docs, exact = np.random.default_rng(8), [], []

    def text(n):
        return [f"v{k}" for k in rng.integers(0, 20000, n)]

    for k in range(48):
        passage = text(50 + 5 * (k % 3))
        low = list(passage)
        for at in rng.choice(len(passage), 1 + k % 4, replace=False):
            low[at] = "other"
        docs += [(3 * k, " ".join(text(20) + low + text(15))), (3 * k + 1, " ".join(text(30) + passage)), (3 * k + 2, " ".join(passage + text(25)))]
        exact.append((3 * k + 1, 3 * k + 2, len(passage)))
    got, want = _found(spark, docs, hot=hot), plain_passages(docs)
    links = {(d, e) for (d, _), own in zip(docs, want, strict=True) for e in own}
    assert all(a in got[b].sources and got[b].spans[0].start == 0 and got[b].spans[0].end >= n for a, b, n in exact)
    assert len(links & {(d, e) for d in got for e in got[d].sources}) >= 0.9 * len(links)
    for (d, _), own in zip(docs, want, strict=True):
        words = {i + k for starts in own.values() for i in starts for k in range(50)}
        assert {k for s in got[d].spans for k in range(s.start, s.end)} <= words
        assert set(got[d].sources) <= set(own)


@pytest.mark.parametrize("hot", [1 << 14, 1])
def test_substring_dedup_recall_at_the_threshold(spark, hot):
    """Passages of 50 words with one other word, at similarity 0.804: found as often as the docstring says, split or not."""
    rng, docs, n = np.random.default_rng(21), [], 600
    for k in range(n):
        own = [f"u{k}x{w}" for w in range(50)]
        other = list(own)
        other[rng.integers(5, 45)] = "changed"
        docs += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    got = _found(spark, docs, hot=hot)
    found = sum(got[2 * k + 1].sources == [2 * k] for k in range(n))
    assert found >= 0.97 * n
    assert all(not got[2 * k].sources for k in range(n))


def test_classes_of_a_large_group(spark):
    """Copies with words changed here and there, more than a group compares at once: one class, as by brute force."""
    rng, docs = np.random.default_rng(2), []
    base = [f"b{k}" for k in range(70)]
    for k in range(40):
        own = list(base)
        for at in rng.choice(70, rng.integers(0, 5), replace=False):
            own[at] = f"c{k}x{at}"
        docs.append((k, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc: r["class"] for r in window_dedup.classes(df).collect()}
    root = list(range(40))
    for d, own in enumerate(plain_passages(docs)):
        for e in own:
            a, b = root[d], root[e]
            root = [min(a, b) if x in (a, b) else x for x in root]
    assert sum(got[k] == root[k] for k in range(40)) >= 39


def test_passages_with_repeated_shingles_are_verified():
    a = np.arange(1, 101, dtype=np.uint64)
    # a shingle of the passage also stands long before it
    b = np.concatenate([a[50:51], np.arange(1000, 1040, dtype=np.uint64), a])
    assert window_dedup.verified(a, b).all()
    # one value many times is not many values
    same = np.full(60, 7, np.uint64)
    assert not window_dedup.verified(same, np.concatenate([same[:1], np.arange(2000, 2060, dtype=np.uint64)])).any()
    assert window_dedup.verified(same, same).all()


def _repeating(n):
    """Contexts of one pivot that repeat it between words of their own, as many words alike as not: (data, size)."""
    rng, parts = np.random.default_rng(6), []
    for _ in range(n):
        edge = [rng.integers(10, 13, 1), rng.integers(20, 24, 1), rng.integers(30, 36, 1), rng.integers(40, 48, 1), rng.integers(50, 1000, 1)]
        run, after = np.full(rng.integers(20, 44), 1), np.full(rng.integers(20, 40), rng.integers(2, 5))
        parts.append(np.concatenate([rng.integers(1000, 2000, rng.integers(0, 12)), run, *edge, after]))
    return np.concatenate(parts).astype(np.uint32), np.array([len(x) for x in parts])


def test_sets_of_few_shingles_are_matched_as_by_verification():
    data, size = _repeating(90)
    cut = np.concatenate([[0], np.cumsum(size)])
    sets = window_dedup.Sets(data, size, np.ones(len(data), bool))
    assert (sets.own >= 0).any() and (sets.own < 0).any()
    for k in range(90):
        a, few = data[cut[k] : cut[k + 1]], sets.own[cut[k] : cut[k + 1]] >= 0
        near = sets.like_any(cut[k], cut[k + 1], 90)
        for j in range(0, 90, 7):
            want = np.zeros(len(a), bool)
            want[: len(a) - window_dedup.LEAST + 1] = window_dedup.verified(a, data[cut[j] : cut[j + 1]])
            assert (near[:, j] == (want & few)).all() and (sets.like_one(j)[cut[k] : cut[k + 1]] == (want & few)).all()


def test_a_large_group_of_repeated_words_is_not_compared_pair_by_pair(monkeypatch):
    data, size = _repeating(600)
    n, calls, plain = 600, [], window_dedup.verified
    monkeypatch.setattr(window_dedup, "verified", lambda a, b: calls.append(1) or plain(a, b))
    x = window_dedup.Contexts(np.full(n, 9, np.uint64), np.arange(n), np.zeros(n, np.int64), size - window_dedup.LEAST, size, data)
    before = x.alive.copy()
    k, owner, _, _ = x.link()
    assert len(calls) < 10 * n and (owner < k).all() and len(k)
    # what few different shingles leave open has no counterpart before it
    few, cut, checked = x.few[:-1], x.off, 0
    for c in range(1, n, 41):
        for i in np.flatnonzero((before & x.alive)[cut[c] : cut[c + 1]] & few[cut[c] : cut[c + 1]])[::9].tolist():
            a = data[cut[c] + i : cut[c] + i + window_dedup.LEAST]
            assert not any(plain(a, data[cut[j] : cut[j + 1]]).any() for j in range(c))
            checked += 1
    assert checked


def test_pivots_travel_in_a_row_for_each_bucket():
    """Rows grew with buckets times homes of a task, that is with the square of the text."""
    rng = np.random.default_rng(9)
    pivot, key, home = rng.integers(0, 3000, 9000).astype(np.uint64), rng.integers(0, 2, 9000).astype(np.uint32), rng.integers(0, 70, 9000)
    rows, got = window_dedup.seen_rows(pivot, key, home, 50), Counter()
    assert len(rows) == 50
    for bucket, homes, counts, pivots, keys, many in rows:
        own, k = window_dedup.unsix(pivots), np.frombuffer(keys, np.uint32)
        h, more = np.repeat(np.frombuffer(homes, np.int32), np.frombuffer(counts, np.int32)), np.unpackbits(np.frombuffer(many, np.uint8), count=len(own))
        assert (own % np.uint64(50) == bucket).all()
        got.update(dict(zip(zip(own.tolist(), k.tolist(), h.tolist(), strict=True), more.tolist(), strict=True)))
    want = Counter(zip(pivot.tolist(), key.tolist(), home.tolist(), strict=True))
    assert got == Counter({x: int(n > 1) for x, n in want.items()})


@pytest.mark.parametrize("op", [suffix_dedup.spans, jaccard_join.classes, line_dedup.removed_lines, line_dedup.dedup, window_dedup.classes, jaccard_join.keep_first])
def test_empty_tables(empty, op):
    assert op(empty).count() == 0


def test_columns_named_like_results_in_dedup(documents):
    docs = documents.withColumns({c: F.lit(7) for c in ["doc", "n", "node", "component", "home", "gone", "h", "no", "spans", "kept", "_doc", "_gone", "_new", "u", "root", "class"]})
    assert suffix_dedup.spans(docs).count() == window_dedup.passages(docs).count() == jaccard_join.classes(docs).count() == docs.count()
    assert jaccard_join.keep_first(docs).columns == line_dedup.dedup(docs).columns == docs.columns
