from __future__ import annotations

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from evigraph.llm import secrets as S

TABLES = S.automaton()


def plain(text):
    out = []
    for k, (kind, (pattern, group, least)) in enumerate(S.RULES.items()):
        for m in re.finditer(pattern, text, re.I | re.A if kind == "assign" else 0):
            if len(m[group]) >= least:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


PIECES = ["secret", "Token", "api_key", "APIKEY", ":", "=", " ", '"', "'", "AKIA", "0123456789abcdef", "ABCDEFGHIJ12", "é", "x", "/", "ghp_", "-----BEGIN RSA PRIVATE KEY-----", "deadbeef"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_spans(text):
    assert S.spans(text.encode(), TABLES) == plain(text)


def test_automaton_misses_no_rule():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(PIECES) for _ in range(30))
        assert {k for k, _, _ in plain(text)} <= set(S.ends(text.encode(), TABLES))


def test_rows(spark):
    texts = [None, "", "é password: hunter22 " + "ab" * 12, "secret=token: abcdefg", "x" * 300000 + " token=abcdef"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts + texts[:3])], "doc_id long, text string, found int")
    got = {r.doc_id: r for r in S.digest(S.secrets(docs)).collect()}
    assert S.secrets(docs).count() == 8 and S.secrets(docs.limit(0)).count() == 0
    for i, t in enumerate(texts):
        assert got[i].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in plain(t or ""))
    assert (got[2].n_assign, got[2].n_access, got[2].n_hex) == (1, 0, 1)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "secret", "=", ":", "ab", "abcdef", " ", "'", "AKIA", "A", "é", "."]), max_size=24).map("".join))
def test_overlapping_matches(text):
    assert S.spans(text.encode(), TABLES) == plain(text)
