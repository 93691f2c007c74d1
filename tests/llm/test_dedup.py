"""Operators 4, 5 and 6 against brute force."""

import hashlib
import re

import pytest

from candela.llm import jaccard, lines, substrings
from candela.llm.bits import Layout

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
words = lambda s: re.findall(r"[^\x20\x09-\x0D]+", s or "")


def brute_lines(rows, min_docs):
    keys = {d: [low(x.strip(SPACE)) for x in (t or "").split("\n")] for d, t in rows}
    count = {}
    for ks in keys.values():
        for k in set(ks) - {""}:
            count[k] = count.get(k, 0) + 1
    out = {}
    for d, t in rows:
        raw = (t or "").split("\n")
        kept = [x for x, k in zip(raw, keys[d]) if count.get(k, 0) < min_docs]
        out[d] = (len(raw), len(raw) - len(kept), sha("\n".join(kept)))
    return out


def test_lines(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for min_docs in (2, 10):
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.digests(docs, min_docs).collect()}
        assert got == brute_lines(rows, min_docs)
    assert sum(v[1] for v in brute_lines(rows, 10).values()) > 20
    assert lines.digests(no_docs).collect() == []


def test_lines_full_filter_and_join_path(docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 1)
    got = lines.dedup_lines(docs.withColumnRenamed("lang", "key"), 2, layout=Layout(bits=64 * 8, buckets=64, hashes=2))
    assert set(got.columns) == {*docs.columns, "key", "n_lines", "n_dropped", "kept_text"} - {"lang"}
    assert {r.doc_id: (r.n_lines, r.n_dropped, sha(r.kept_text)) for r in got.collect()} == brute_lines(rows, 2)


def test_lines_join_path_trims_as_the_other(spark, monkeypatch):
    line = ["for the staff", "\x0cform feed\x0c", "f", "\x0b v \x0c\r", "\xa0no break\xa0", "OFF", "off\x0c"]
    rows = [(1, "\n".join(line)), (2, "\n".join(reversed(line))), (3, "or the sta\nform feed\nff"), (4, "own\x0c\nFOR THE STAFF"), (5, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows, 2)
    assert (want[1], want[3][1], want[4][1]) == ((7, 7, sha("")), 1, 1)
    for bound in (lines.BROADCAST_ROWS, 1):
        monkeypatch.setattr(lines, "BROADCAST_ROWS", bound)
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.digests(d, 2).collect()} == want, bound


def test_lines_long_keys_are_joined(spark, monkeypatch):
    rows = [(1, "x" * 500 + "\nown"), (2, "a\n" + "x" * 500), (3, "A\nyes")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    joined, join = [], lines._with_own_drops
    monkeypatch.setattr(lines, "_with_own_drops", lambda *a: joined.append(1) or join(*a))
    for bound in (501, 500):  # the repeated keys have 501 bytes
        monkeypatch.setattr(lines, "BROADCAST_BYTES", bound)
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.digests(d, 2).collect()} == brute_lines(rows, 2)
        assert len(joined) == (bound == 500)


def test_lines_first_stays(spark):
    d = spark.createDataFrame([(2, "A\nx"), (1, "y\na \nA"), (3, "a")], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in lines.dedup_lines(d, 2, keep_first=True).collect()}
    assert got == {1: "y\na ", 2: "x", 3: ""}


@pytest.mark.parametrize("bound", [500_000, 0])
def test_lines_first_stays_without_ids_and_with_repeated_ones(spark, monkeypatch, bound):
    """Twelve texts without an id, or of one id: one of them keeps the line. Rows equal in id and text keep it together."""
    monkeypatch.setattr(lines, "BROADCAST_ROWS", bound)
    for doc in (None, 5):
        d = spark.createDataFrame([(doc, f"shared\nown {i}") for i in range(12)], "doc_id long, text string")
        kept = [r.kept_text for r in lines.dedup_lines(d, 10, keep_first=True).collect()]
        assert sorted(x.split("\n")[-1] for x in kept) == sorted(f"own {i}" for i in range(12))
        assert sum("shared" in x for x in kept) == 1
    d = spark.createDataFrame([(None, "a\nx"), (3, "y\na"), (3, "y\na"), (4, None)], "doc_id long, text string")
    assert sorted(r.kept_text for r in lines.dedup_lines(d, 2, keep_first=True).collect()) == ["", "x", "y\na", "y\na"]


def brute_substrings(rows, width=13):
    first = {}
    for d, t in sorted(rows, key=lambda x: x[0]):
        w = words(t)
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    out = {}
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_substrings(docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_substrings(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digests(docs).collect()} == want
    assert sum(v[1] > 0 for v in want.values()) > 10
    assert substrings.digests(no_docs).collect() == []


def test_substrings_many_batches_compact(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = substrings.dedup_substrings(docs, width=5, gram=3, batches=6)
    assert {r.doc_id: (r.n_words, r.n_removed, sha(r.kept_text)) for r in got.collect()} == brute_substrings(rows, 5)


def test_substrings_popular_windows_and_odd_rows(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, f"own{i} a b {passage} tail{i}") for i in range(60)] + [(3, f"other {passage}"), (None, passage), (None, None), (70, passage), (70, passage)]
    d = spark.createDataFrame([(*r, 1, "v") for r in rows], "doc_id long, text string, tag long, `a.b` string")
    for popular in (2, 1000):
        monkeypatch.setattr(substrings, "POPULAR", popular)
        got = sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digests(d).collect())
        first, want = {}, []
        for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
            for k in range(len(words(t)) - 12):
                first.setdefault(tuple(words(t)[k : k + 13]), i)
        for i, t in rows:
            w = words(t)
            gone = {k + j for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for j in range(13)}
            want.append((repr(i), len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
        assert got == sorted(want)


def test_registered_batches_compact_the_index(docs, monkeypatch):
    merged, compact = [], substrings.FingerprintIndex.compact
    monkeypatch.setattr(substrings.FingerprintIndex, "compact", lambda self: merged.append(1) or compact(self))
    substrings.digests(docs).count()
    assert len(merged) >= 1 and substrings.BATCHES > substrings.RUNS


def test_index_is_incremental(spark, docs, tmp_path):
    path = (tmp_path / "index").as_uri()
    one = substrings.FingerprintIndex(spark, path, max_runs=1)
    one.add(docs.where("doc_id % 2 = 0")).count()
    one.add(docs.where("doc_id % 2 = 1 and doc_id < 100")).count()
    assert len(one.runs) == 1  # compacted
    again = substrings.FingerprintIndex(spark, path)
    assert [r.rpartition("/")[2] for r in again.runs] == [r.rpartition("/")[2] for r in one.runs]
    hits = again.add(docs).agg({"hits": "count"}).first()[0]
    assert hits > 0


def brute_groups(rows, n, percent):
    sets = {}
    for d, t in rows:
        w = words(low(t or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(sets, 0)
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inter >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), links[d]) for d in sets}


def test_groups(docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for n, percent, unit in ((4, 85, 1500), (2, 30, 5)):
        want = brute_groups(rows, n, percent)
        got = jaccard.similar_groups(docs, n, percent, unit=unit)
        assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got.collect()} == want, (n, percent)
    assert jaccard.similar_groups(no_docs).collect() == []


def test_broadcast_rows_do_not_grow_with_the_block(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:40], f"own{i}", *base[40:]])) for i in range(30)]
    narrow, small = [], jaccard.small
    monkeypatch.setattr(jaccard, "small", lambda df: narrow.append(df.dtypes) or small(df))
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80, unit=3)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got.collect()} == brute_groups(rows, 2, 80)
    assert narrow and all(kind in ("int", "bigint") for _, kind in narrow[0])


def brute_rows(rows, n, percent):
    """Rows stand for themselves: (n_shingles, component_id, n_links) of each, with repeated and null ids."""
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]
    by_row = brute_groups(numbered, n, percent)
    out = []
    for i, (size, root, links) in by_row.items():
        ids = [rows[j][0] for j, (_, r, _) in by_row.items() if r == root and rows[j][0] is not None]
        out.append((rows[i], size, (min(ids, default=None) if size else rows[i][0]), links))
    return sorted(out, key=repr)


def test_groups_of_repeated_and_null_ids(spark):
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    near = lambda w: " ".join([*w[:30], "own", *w[31:]])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(a)), (8, near(b)), (None, " ".join(a)), (None, near(b)), (None, "alone it stands"),
            (9, "x y z"), (9, "x y z"), (9, "x y z"), (None, None), (None, ""), (3, None), (3, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id + 1 `_id`", "text `d1`", "'x' `a.b`")
    got = [((r.doc_id, r.text), r.n_shingles, r.component_id, r.n_links) for r in jaccard._groups(d, 3, 70).join(
        spark.createDataFrame(rows, "i long, text string").distinct().selectExpr("i", "text", "xxhash64(coalesce(text, '')) tag"), "tag").where("doc_id <=> i").collect()]
    want = brute_rows(rows, 3, 70)
    assert {repr(g) for g in got} == {repr(w) for w in want}
    one = jaccard.one_of_each(d, 3, 70)
    assert one.columns == d.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in one.collect()))) == sorted(map(repr, [rows[0], rows[1], rows[6], rows[7], *rows[10:]]))
    assert jaccard.one_of_each(d.limit(0)).collect() == []


def test_one_of_each(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {d for d, (_, c, _) in brute_groups(rows, 5, 80).items() if c == d}
    got = jaccard.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)
