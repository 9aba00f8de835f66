"""The source audit against a plain version, and its transducers against sets of terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from resultmart.llm.divergence import Transducer, _shares, audit_sources

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, min_docs=10, top=10):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(UPPER))) for text, lang, source in rows]
    held = Counter((lang, t) for lang, _, ts in docs for t in set(ts))
    kept = defaultdict(list)
    for (lang, t), n in held.items():
        if n >= min_docs:
            kept[lang].append(t)
    counts = defaultdict(Counter)
    for lang, source, ts in docs:
        for key in ((lang, source), (lang, None)):
            counts[key].update(t for t in ts if held[lang, t] >= min_docs)
    share = {key: {t: 1 + 10**9 * (n[t] + 2) // (n.total() + 2 * len(kept[key[0]])) for t in kept[key[0]]} for key, n in counts.items()}
    out = []
    for lang, source in counts:
        if source is None:
            continue
        p, q = share[lang, source], share[lang, None]
        pairs = [(o, sum((p[t] - r) ** 2 // (p[t] + r) for t, r in share[lang, o].items())) for x, o in counts if x == lang and o not in (None, source)]
        terms = [(t, (p[t] - q[t]) ** 2 // (p[t] + q[t])) for t in p if counts[lang, source][t] and p[t] > q[t]]
        for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abcé日", min_size=1, max_size=6), min_size=1, max_size=40), st.lists(st.text("abcdé日", min_size=1, max_size=6), max_size=20))
def test_transducer(held, others):
    terms = sorted(x.encode() for x in held)
    made = Transducer.from_parts(Transducer.of(terms).parts())
    asked = terms + [x.encode() for x in others]
    raw = np.frombuffer(b" ".join([*asked, b""]), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in asked]) - 1
    starts = ends - [len(x) for x in asked]
    assert made.ordinals(raw, starts, ends).tolist() == [terms.index(x) if x in terms else -1 for x in asked]
    assert list(made.terms()) == terms
    prefixes = {x[:k] for x in terms for k in range(len(x) + 1)}
    assert len(made.final) == len({frozenset(x[len(p) :] for x in terms if x.startswith(p)) for p in prefixes})  # minimal


def test_transducer_wants_order():
    with pytest.raises(ValueError):
        Transducer.of([b"b", b"a"])
    assert Transducer.of([]).n == 0


def test_shares_are_exact():
    n = np.array([0, 1, 123_456_789_012_345, 9_999_999_999_999])
    for total, terms in ((124_000_000_000_000, 777), (3_000_000_000_000_001, 1), (10**16, 10**8)):
        assert _shares(n, total, terms).tolist() == [1 + 10**9 * (int(x) + 2) // (total + 2 * terms) for x in n]


def table(seed=1, n=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 5))) for _ in range(60)] + ["Zz", "日本", "\U0001f600"]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", ".", "'", "\n", "9"]) for _ in range(rng.randrange(0, 40))).title(), rng.choice(["en", "de", None]), rng.choice(["s0"] * 20 + [f"s{i}" for i in range(12)] + [None, "é", "z"])) for _ in range(n)]
    rows += [("rare words only", "fr", "a"), (None, "fr", "b"), ("", "fr", None), ("alone", "xx", "one"), ("x" * 100_000, "en", "s0"), ("1234 --", "en", "no terms")]
    return rows


@pytest.mark.parametrize("way", [{}, {"broadcast_bytes": 0, "tile_terms": 8}, {"shard_terms": 3, "tile_sources": 4}, {"broadcast_bytes": 0, "shard_terms": 7, "tile_terms": 5, "tile_sources": 1}])
def test_audit(spark, way):
    rows = table()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n long, term string").repartition(6)
    found = audit_sources(docs, **way)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == plain(rows)


def test_empty(spark):
    assert audit_sources(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
    one = spark.createDataFrame([("a few words", "en", "s")] * 3, "text string, lang string, source string")
    assert audit_sources(one).count() == 0
