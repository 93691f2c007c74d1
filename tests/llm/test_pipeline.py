"""The pipeline against a chain of plain functions on lists."""

import math
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.llm import mixing, quality
from candela.llm.tokens import vocabulary

from test_dedup import brute_groups, low, words
from test_texts import brute_base, brute_mix

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def quartile(values, p):
    return sorted(values)[max(0, math.ceil(p * len(values)) - 1)]


def measures(text):
    import sentencepiece

    model = measures.model = getattr(measures, "model", None) or sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    w = words(text)
    ids = [i for x in w for i in model.encode(x)]
    if not ids:
        return None
    p = [c / len(ids) for c in Counter(ids).values()]
    return {"chars_per_token": sum(map(len, w)) / len(ids), "byte_share": sum(map(model.IsByte, ids)) / len(ids),
            "evenness": -sum(x * math.log2(x) for x in p) / math.log2(len(ids)) if len(ids) > 1 else 0.0}


def brute_quality(rows, min_group=100):
    """rows: (doc_id, text, lang, source). Those that stay."""
    base, groups = [], defaultdict(list)
    for r in rows:
        n, *_, repeated = brute_base(r[1])
        ok = not (n < 50 or 100 * repeated > 50 * n)
        base.append((ok, min(int(math.log2(max(n, 1))), 14), measures(r[1])))
        if ok:
            for key in ((r[2] or "und", base[-1][1]), base[-1][1], None):
                groups[key].append(base[-1][2])
    out = []
    for r, (ok, size, m) in zip(rows, base):
        for c, (below, above, least) in quality.BANDS.items():
            if not ok:
                break
            key = next(k for k in ((r[2] or "und", size), size, None) if k is None or len(groups[k]) >= min_group)
            q1, q2, q3 = (quartile([g[c] for g in groups[key]], p) for p in (0.25, 0.5, 0.75))
            spread = max(q3 - q1, least)
            ok = (below is None or m[c] >= q2 - below * spread) and (above is None or m[c] <= q2 + above * spread)
        if ok:
            out.append(r)
    return out


def brute_first_lines(rows, min_docs=10):
    count, first = Counter(), {}
    for r in sorted(rows, key=lambda r: r[0]):
        keys = [low(x.strip(SPACE)) for x in (r[1] or "").split("\n")]
        count.update(set(keys) - {""})
        for i, k in enumerate(keys):
            first.setdefault(k, (r[0], i))
    out = []
    for r in rows:
        kept = [x for i, x in enumerate((r[1] or "").split("\n")) if count[k := low(x.strip(SPACE))] < min_docs or first[k] == (r[0], i)]
        out.append((r[0], "\n".join(kept), *r[2:]))
    return out


def brute_run(rows):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = brute_first_lines(brute_quality(rows))
    groups = brute_groups([r[:2] for r in rows], 5, 80)
    rows = [r for r in rows if groups[r[0]][1] == r[0] or not groups[r[0]][0]]
    domain = lambda s: mixing.DOMAINS.get(s, "other")
    taken = brute_mix([(r[0], (domain(r[3]), r[2], r[3]), len(words(r[1])), r[1]) for r in rows], mixing.SHARE, mixing.EPOCHS, mixing.SEED)
    texts, pieces = {r[0]: r[1] for r in rows}, Counter()
    for doc, _ in taken:
        ids = t.encode(texts[doc], add_special_tokens=False).ids + [2]
        first = len(ids) - 1024 * ((len(ids) - 1) // 1024)
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        pieces.update((doc, k, a, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    return pieces


@pytest.fixture(scope="module")
def corpus():
    r = np.random.default_rng(3)
    vocab = np.array(["the", "river", "of", "light", "and", "über", "straße", "maison", "señor", "window", "paper", "quiet", "runs", "over", "small", "green", "hills", "while", "nobody", "listens"] + [f"w{i}x" for i in range(400)])
    out = []
    for i in range(160):
        text = "\n".join(" ".join(r.choice(vocab, 9)) for _ in range(r.choice([2, 9, 30])))
        if i % 4 == 0:
            text = "All rights reserved\n" + text + "\n  all RIGHTS reserved "
        out.append((i, text, ["en", "de"][i % 2], f"site{i % 5}"))
    out += [(200 + i, out[i][1], "en", "mirror") for i in range(0, 40, 3)]
    out += [(300 + i, out[i][1] + " tail", "en", "mirror") for i in range(1, 40, 3)]
    out += [(400, "buy now " * 80, "en", "site1"), (401, "", "en", "site1"), (402, "☃☄★☂" * 300 + " " + "☃ ☄ ★ ☂ ♞ ♟ " * 12, "en", "site2")]
    return out


def test_run_matches_brute_force(spark, corpus, tmp_path):
    d = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    d.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute_run(corpus)
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == want and len(want) > 40
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    ends = defaultdict(list)
    for r in got:
        ends[r.sequence_id].append((r.offset, r.length))
    for s in ends.values():
        s.sort()
        assert [o for o, _ in s] == list(np.cumsum([0] + [n for _, n in s])[:-1]) and sum(n for _, n in s) <= 1024
    assert len({(r[0], r[1]) for r in corpus}) > len({r.doc_id for r in got}) and not {400, 401} & {r.doc_id for r in got}


def test_stages_take_empty_and_odd_tables(spark, corpus):
    kind = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, take int, _id long, n_lines long, kept string"
    for name, stage in corpus_pipeline.STAGES:
        empty = spark.createDataFrame([], kind)
        out = stage(spark, empty, "")
        assert out.collect() == [] and (name == "best-fit packing" or out.columns == empty.columns), name
    odd = [(1, None, None, None, None), (1, None, None, None, None), (None, corpus[0][1], "en", None, 3), (2, "", "en", "s", 0), (2, corpus[0][1], None, "s", 1), (2, corpus[0][1], None, "s", 1)]
    odd += [(10 + i, *corpus[i][1:], None) for i in range(1, 30)]
    d = spark.createDataFrame([(*r, "x", 1, 2, 3, "k") for r in odd], kind)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, "")
        rows = out.count()
        if name == "best-fit packing":
            assert rows >= len(odd)
        else:
            assert out.columns == d.columns and out.where("`a.b` <> 'x' or take <> 1 or _id <> 2 or n_lines <> 3 or kept <> 'k'").isEmpty(), name
            assert rows <= len(odd) if name != "mixing sources to target weights" else rows <= 2 * len(odd)
    near = corpus_pipeline.near_duplicates(spark, d, "").collect()
    assert sum(r.text == corpus[0][1] for r in near) == 1 and sum(not (r.text or "") for r in near) == 3

