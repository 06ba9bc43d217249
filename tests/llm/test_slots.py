"""Personal data in the slots beside strong patterns, whatever it looks like."""

import hashlib
import random
import re

from helpers import documents

from skeinflow.llm import pii

#: The contract's base patterns, as it writes them.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def odd_texts():
    rng = random.Random(3)
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.4", "a@b.co", "a.b+c@x-1.co.uk", "@", "x@y", "q@w.e@r.t", "+1 (265) 555-5428", "+12", "+1234567890123456", "é", "ß.", "\n", " ", "  ", "...", "***", "=", ":", '"', "key", "token = ", "abcdef123456", "7", "-", "+", "(", ")"]
    return [None, "", " ", "***", "a ***", '="', "token=", "x:", *("".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 30))) for _ in range(300)), " ".join(rng.choice(parts) for _ in range(4000))]


def test_base_columns(spark, tmp_path):
    texts = odd_texts()
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.op6_personal_data(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        want, r = plain_base(t), got[i]
        assert [r[f"n_{k}"] for k in BASE] == [sum(w[0] == k for w in want) for k in BASE], t
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(said.split(",") if said else []) <= set(spans) and len(spans) == len(want) + r.n_found


def test_secrets_where_confident_patterns_point(spark):
    """Values that are given to a name are seeds; values of other looks, and under other names, come out by their contexts alone."""
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(n))
    value = lambda n: "a1" + "".join(rng.choice("0123456789abcdef") for _ in range(n - 2))
    seeds = [f'{prose(9)} token = "{value(40)}" {prose(9)}' for _ in range(40)]
    unseen = [(f'{prose(9)} token = "', x, f'" {prose(5)}') for x in ("correct-horse", "Zx9", "hunter two", "12345")] + [(f'{prose(9)} zugang = "', value(40), f'" {prose(9)}') for _ in range(6)]
    plain = [f"{prose(5)} {value(40)} {prose(5)}" for _ in range(20)] + [f"x = {i} {prose(3)}" for i in range(20)] + [f"the key: {prose(3)}" for _ in range(9)]
    texts = seeds + ["".join(x) for x in unseen] + plain
    out = {r.doc_id: [texts[r.doc_id][s.start : s.stop] for s in r.spans] for r in pii.find_personal_data(documents(spark, texts)).collect()}
    assert all(len(out[i]) == 1 and len(out[i][0]) == 40 for i in range(40))
    found = [out[40 + i] for i in range(len(unseen))]
    assert sum(f == [x[1]] for f, x in zip(found, unseen, strict=True)) >= 0.9 * len(unseen), found
    assert not any(out[i] for i in range(40 + len(unseen), len(texts)))


VALUES = ["jane.doe-at-mail", "AB12345", "020 7946 0958", "(265) 555-5428", "GB29 NWBK 6016 1331", "Jane Doe", "12 34 5678 90"]


def test_slots_of_any_form(spark):
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choice("alpha beta gamma delta omega sigma kappa".split()) + chr(97 + rng.randrange(26)) for _ in range(n))
    texts = [f"{prose(6)} contact: {chr(97 + i % 26)}{i}@mail{i % 7}.example.com regards {prose(6)}" for i in range(60)]
    texts += [f"{prose(6)} contact: {v} regards {prose(6)}" for v in VALUES]
    # "about" stands before as many seeds, but before far more that is none.
    texts += [f"about x{i}@mail.example.com {prose(4)}" for i in range(20)] + [f"{prose(3)} about {prose(5)}" for _ in range(200)]
    out = {r.doc_id: r.spans for r in pii.find_personal_data(documents(spark, texts)).collect()}
    assert [[texts[i][s.start : s.stop] for s in out[i]] for i in range(60, 60 + len(VALUES))] == [[v] for v in VALUES]
    assert all(len(out[i]) == 1 for i in range(60)) and not any(out[i] for i in range(80 + len(VALUES), len(texts)))


def test_planted_identifiers(spark, tmp_path):
    """Identifiers that no seed pattern matches, in the seeds' context: all are found, and what is found is split from seeds."""
    import random as r

    rng = r.Random(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta."]) for _ in range(rng.randrange(30))) for _ in range(120)] + [None, "", 'token = "a1b2c3d4e5f6a7b8"']
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = pii.planted(docs).collect()
    for x in rows:
        if x.start is not None:
            value = x.text[x.start : x.stop]
            assert x.text[: x.start].endswith(pii.BEFORE) and x.text[x.stop :] == pii.AFTER and not pii.base_spans(value) and not pii.secrets(x.text[-80:])
    got = {x.doc_id: x for x in pii.planted_identifiers(spark, str(tmp_path)).collect()}
    assert all((x.planted, x.found, x.others) == (i % 5 == 3, i % 5 == 3, 0) for i, x in got.items()) and len(got) == len(texts)
    assert sum(x.planted for x in got.values()) > 20
    plain = {x.doc_id: x for x in pii.op6_personal_data(spark, str(tmp_path)).collect()}
    assert all(x.n_unseen <= x.n_found for x in plain.values())
