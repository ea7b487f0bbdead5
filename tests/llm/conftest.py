import random
import string

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, text_digest string, home int, bucket int, shard int, fp long, item string, _words string, mix_copy string"


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with every odd case: null, empty, blank, short, long, copies, near copies, passages, other scripts."""
    rng = random.Random(7)
    voc = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9))) for _ in range(400)]
    passage = prose(rng, 60, voc)
    out = [None, "", "  \n ", "one", "Two words", "a b c d", "ÉCOLE l'été 日本語 ﬁ Σας", "x" * 400, "ab " * 200, "nul\x00 byte  here's  it"]
    base = [prose(rng, rng.randint(30, 200), voc) for _ in range(20)]
    out += base
    out += [base[0]] * 4 + [base[1].upper()]
    for b in base[2:8]:
        w = b.split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out += [prose(rng, 40, voc) + " " + passage + " " + prose(rng, 40, voc) for _ in range(6)]
    out.append(prose(rng, 20_000, voc))
    for k in range(12):  # a chain of near copies, each a little further from the first
        w = base[9].split()
        for j in range(0, k):
            w[(j * 11) % len(w)] = f"edit{j}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(k * 3, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, len(t or ""), "clash", "clash", 1, 2, 3, 4, "i", "w", "m") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
