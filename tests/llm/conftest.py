from __future__ import annotations

import random

import pytest

WORDS = "The of and theaea onti thnted erre ndwh hation; It over, edly sting ereat tionhe anre. Ing ble was for thth este".split()
#: Extra columns whose names the operators use inside.
EXTRA = ["size", "block", "kind", "rep", "spans", "component_id", "kept", "p", "h", "place", "_terms", "_base", "_id", "_copies", "_n", "_keep", "_copy", "_k1", "_k2", "_k3", "k1", "k2", "tie", "doc", "copies", "nth", "held", "held_out", "score"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "x", "ly", str(r.randrange(9))]) for _ in range(n))


def odd_texts() -> list[str | None]:
    base = prose(1, 120)
    return [
        base, base, base.replace("of", "off", 1), None, "", " \t\n", "a", "two words", "é" * 150 + " naïve e\u0301 \U0001f600", prose(2, 4000), "x" * 70_000, "und " * 600,
        prose(3, 60) + "\n" + "same line here\n" * 5, base[:200] + prose(4, 50), "Ab" + "\x1c\xa0" + "c 12.5, don't. <|endoftext|> ...", "\n".join(["line", "line", "", "line"]),
    ]


@pytest.fixture(scope="session")
def make(spark):
    """docs from texts, with the given ids or 0, 1, ..."""

    def build(texts, extra=True, ids=None):
        rows = [(i, t, "en", f"s{k % 3}" if k % 5 else None, len(t or "")) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts))]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("x") for c in EXTRA})
        return df.repartition(3)

    return build


@pytest.fixture(scope="session")
def odd(make):
    return make(odd_texts())


@pytest.fixture(scope="session")
def empty(make, odd):
    return odd.limit(0)


def ragged_rows() -> list[tuple[int | None, str | None]]:
    """(doc_id, text): repeated rows, rows without id (with equal and with different texts), one id with several texts."""
    shared = prose(70, 60)
    mail = " write to jo.doe@example.org or Quillfeather-Zyx, at once "
    out = list(enumerate(odd_texts()))
    out += [(100 + i, prose(800 + i, 70)) for i in range(30)]
    out += [(40, prose(40, 80)), (40, prose(41, 300) + shared), (40, shared + prose(42, 20)), (40, prose(40, 80)), (40, None), (40, "")]
    out += [(None, prose(43, 200) + shared), (None, prose(44, 90)), (None, prose(44, 90)), (None, prose(44, 90).replace("of", "off", 1)), (None, None), (None, "")]
    out += [(50, prose(45, 40) + mail + prose(46, 30)), (None, prose(47, 50) + mail), (50, mail + prose(48, 60)), (50, prose(45, 40) + mail + prose(46, 30))]
    return out + [(60, prose(49, 120)), (60, prose(49, 120)), (61, prose(49, 120)), (None, prose(49, 120)), (-(1 << 63), shared), ((1 << 63) - 1, prose(90, 30))]


@pytest.fixture(scope="session")
def ragged(make):
    rows = ragged_rows()
    return make([t for _, t in rows], ids=[i for i, _ in rows])
