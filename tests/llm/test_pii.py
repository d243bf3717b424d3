import random
import re

from pyspark.sql import functions as F

from changeloom.llm.pii import find_pii, told

from .helpers import corpus, documents

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    spans = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = (True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15)[k]
            if ok:
                spans.append((m.start(), k, m.end()))
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


ODD = [
    "a@b.c_d@e.f x@y ..@-.-", "é a.b@c.d.e.", "a@b@c.d", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 1.2.3 00000000001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111",
    "+1 (415) 555-0100. +12 +1-2-3-4-5-6-7-8-9-0-1 ++1 555 555 5555", "5927243074273351!!", "12345678901234", "x" * 500 + "@y", "1" * 60, "+" * 30 + "1 2 3 4 5 6 7 8 9 0", "9.9.9.9.example@10.0.0.1",
]


def spans(df, **options):
    return [(r.doc_id, r.base, r.found) for r in find_pii(df, **options).select("doc_id", told(F.col("base")).alias("base"), told(F.col("found")).alias("found")).collect()]


def test_base_against_plain_expressions(spark):
    rows = list(enumerate(ODD)) + [(100 + i, t) for i, t in corpus(1)]
    assert sorted((i, b) for i, b, _ in spans(documents(spark, rows))) == sorted((i, brute(t)) for i, t in rows)


def test_patterns_find_unseen_identifiers(spark):
    seeds = [(k, f"words here token = \"{k:02d}{'ab12cd34' * 5}\" and more words") for k in range(8)]
    rows = [*seeds, (50, 'text with token = "S3CR-9917" in it'), (51, "a total = 1234567 of things"), (52, "plain words without any cue"), (53, None)]
    got = {i: f for i, _, f in spans(documents(spark, rows))}
    at = rows[8][1].index("S3CR")
    assert got[50] == f"id:{at}:{at + 9}" and got[51] == got[52] == got[53] == ""
    assert all(got[k].startswith("id:") for k in range(8))


def test_values_carry_over_to_other_cues(spark):
    value = "ab12cd34" * 5
    rows = [(k, f"token = {k}{value}") for k in range(6)] + [(10 + k, f"apikey: {k}{value}") for k in range(6)] + [(30, "apikey: short-77-key")]
    assert {i: f for i, _, f in spans(documents(spark, rows))}[30] == "id:8:20"


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "a@b.cc"), (1, "a@b.cc"), (1, "a@b.cc"), (2, "")]
    assert sorted((i or 0, b, f) for i, b, f in spans(documents(spark, rows))) == [(0, "email:0:6", "email:0:6"), (1, "email:0:6", "email:0:6"), (1, "email:0:6", "email:0:6"), (2, "", "")]
    assert find_pii(documents(spark, [])).count() == 0


def test_long_texts(spark):
    text = "word " * 40_000 + "a@b.cc " * 100_000 + "x" * 30_000
    ((_, base, _),) = spans(documents(spark, [(1, text)]))
    assert base == brute(text)


def method(rows, rounds=3, min_score=0.6, min_support=5):
    """The method, by loops over words: doc_id -> added spans."""
    found = []
    for i, text in rows:
        base = [tuple(map(int, x.split(":")[1:])) for x in brute(text).split(",") if x]
        before = []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
            word, context = m.group(), before[-3:]
            before.append(word)
            if not re.search("[0-9@]", word):
                continue
            key = re.match(r"[\W_]*([^\W\d_][\w.-]*(?:=|:(?!/)))[\W_]*[^\W_]", word)
            shift = key.end(1) if key else 0
            value = re.search(r"[^\W_](?:.*[^\W_])?", word[shift:])
            if not value:
                continue
            plain = lambda w: re.sub("[0-9]", "0", w.lower())
            patterns = {plain(key.group(1))} if key else {" ".join(map(plain, context[-k:])) for k in (1, 2, 3) if k <= len(context)}
            patterns = {p for p in patterns if re.search(r"[^\W\d_]", p)}
            a, b = m.start() + shift + value.start(), m.start() + shift + value.end()
            on_base = any(x < b and a < y for x, y in base)
            value = value.group()
            secret = bool(re.fullmatch("[0-9A-Fa-f]{32,}", value) and re.search("[0-9]", value) and re.search("[A-Fa-f]", value))
            like = len(re.sub(r"[\W_]", "", value)) >= 6 and bool(re.search("[0-9]", value))
            found.append((i, patterns, value, a, b, on_base, on_base or secret, like))
    seeds, values = {}, {}
    for _, patterns, value, _, _, _, seed, like in found:
        for p in patterns if seed or like else ():
            values.setdefault(p, set()).add(value)
            if seed:
                seeds.setdefault(p, set()).add(value)
    link_seed = {(p, v) for p, vs in seeds.items() for v in vs}
    every = {v for vs in values.values() for v in vs}
    seed_score = {v: float(any((p, v) in link_seed for p in values)) for v in every}
    score = dict(seed_score)
    for _ in range(rounds):
        mean = {p: sum(score[v] for v in vs) / len(vs) for p, vs in values.items()}
        sure = {p: x for p, x in mean.items() if x >= min_score and len(seeds.get(p, ())) >= min_support}
        score = {v: max([seed_score[v], *(sure[p] for p in sure if v in values[p])]) for v in every}
    out = {i: set() for i, _ in rows}
    for i, patterns, _, a, b, on_base, _, like in found:
        if not on_base and like and patterns & sure.keys():
            out[i].add((a, 4, b))
    return out


def test_method_against_loops(spark):
    rng = random.Random(2)
    leads = ["reach me at", "account number is", "Call", "total of", "order", "my key", "api_key=", "id:"]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            lead = rng.choice(leads)
            value = rng.choice([f"user{rng.randrange(99)}@mail.example.com", f"10.0.{rng.randrange(200)}.7", f"AB{rng.randrange(10**6):06d}", f"+1 415 555 {rng.randrange(10**4):04d}", "4111 1111 1111 1111", f"{rng.getrandbits(160):040x}", "about 12 items", f"\"no-{rng.randrange(10**5):05d}-x\"."])
            if lead in ("total of", "order") and rng.random() < 0.8:
                value = f"{rng.randrange(10**7):07d}"
            parts += [lead + ("" if lead.endswith("=") else " ") + value, rng.choice(["and", "then some words.", "", "123"])]
        rows.append((i, " ".join(parts)))
    want = method(rows)
    assert 10 < sum(map(len, want.values()))
    names = ["email", "ip", "card", "phone", "id"]
    for i, base, found in spans(documents(spark, rows)):
        both = {(int(a), names.index(k), int(b)) for k, a, b in (x.split(":") for x in base.split(",") if x)} | want[i]
        assert found == ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(both))


def test_patterns_of_prose(spark):
    rows = [(k, f"you can reach me at someone{k}@mail.example.com any day") for k in range(8)] + [(20, "you can reach me at user-99812 any day"), (21, "it had 1234567 of them")]
    got = {i: f for i, _, f in spans(documents(spark, rows))}
    assert got[20] == "id:20:30" and got[21] == ""
