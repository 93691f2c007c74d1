import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_texts(seed=7, n=60):
    """Texts with copies, near copies, shared passages, repeated lines and odd cases."""
    r = random.Random(seed)
    vocab = [a + b for a in ("ka", "lo", "mi", "tu", "ré", "so", "wá", "x") for b in ("n", "ra", "st", "Q", "lem", "ô", "7", "p-p")]
    passage = [r.choice(vocab) for _ in range(40)]
    out = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.choice([3, 14, 60, 200]))]
        if i % 5 == 0:
            at = r.randrange(len(words))
            words[at:at] = passage
        lines, k = [], 0
        while k < len(words):
            step = r.randrange(3, 12)
            lines.append(r.choice([" ", "  ", "\t"]).join(words[k : k + step]))
            k += step
        if i % 4 == 0:
            lines.append("  Terms of Use apply ")
        if i % 3 == 0:
            lines.insert(0, "terms OF use APPLY")
        out.append("\n".join(lines))
    for i in (1, 5, 9):
        out.append(out[i])
        near = out[i].split(" ")
        if len(near) > 40:
            near[20] = "changed"
        out.append(" ".join(near))
    return [*out, "", None, " \n\t ", "one", "two words", "one", "a " * 3000, "\n\n", "ñ" * 50]


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i * 3 + 1, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], SCHEMA).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
