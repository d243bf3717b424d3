"""Small tables and brute-force versions for the training-data operators."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA)


def corpus(seed=0, n=40):
    """Prose with copies, near copies, shared lines, empty and null texts."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ba", "ko", "Ti", "ñu", "ré", "x") for b in ("", "lo", "mi", "sen", "tur", "vek")]
    prose = lambda k: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ".\n"]) for _ in range(k))
    shared = [prose(25) for _ in range(3)]
    rows = []
    for i in range(n):
        kind = rng.randrange(7)
        if kind == 0 and rows:
            text = rng.choice(rows)[1]
        elif kind == 1 and rows and (old := rng.choice(rows)[1]):
            parts = old.split(" ")
            parts[rng.randrange(len(parts))] = "edited"
            text = " ".join(parts)
        elif kind == 2:
            text = prose(rng.randrange(40)) + "\n" + rng.choice(shared) + "\n" + prose(rng.randrange(30))
        elif kind == 3:
            text = rng.choice(["", None, " ", "\n\n", "one", prose(3) + "\n" + prose(2)])
        else:
            text = prose(rng.randrange(1, 120))
        rows.append((i, text))
    return rows
