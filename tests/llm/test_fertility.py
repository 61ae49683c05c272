import random
import re
from collections import Counter

import pytest

from sluicebox.llm.fertility import measure_text, quality_rules, token_caches
from sluicebox.llm.tokens import vocabulary_path

CACHES = token_caches(vocabulary_path("byte_bpe_50k.tiktoken"), vocabulary_path("piece_bpe_32k.model"))
WORDS = "the of a water house under morning people light always going through river because small write number".split()


def by_definition(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, double = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            double += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), double, len(covered)


@pytest.mark.parametrize("seed", range(4))
def test_base_measures_as_defined(seed):
    rng = random.Random(seed)
    parts = ["a", "b", "é", " x", "\x1cq", " ", "\n", "\t", "\x0b", "#", "a b c", "\n\n", " \n"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert measure_text(text, *CACHES)[:5] == by_definition(text), repr(text)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_verdicts(spark):
    rng = random.Random(1)
    good = [(i, prose(rng, rng.randint(60, 300)), "en" if i % 2 else None, "r") for i in range(200)]
    junk = {
        900: " ".join("".join(rng.choice("zqxjkvwpfgbh#@^~") for _ in range(7)) for _ in range(200)),
        901: "spam " * 300,
        902: " ".join(w + rng.choice(["$$$", "***", "%%%"]) for w in prose(rng, 300).split()),
        903: "short text",
        904: None,
        905: "",
        906: prose(rng, 70) + " " + "buy " * 20000,
    }
    rows = good + good[:3] + [(k, t, "en", "r") for k, t in junk.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, reason string")
    found = {}
    for r in quality_rules(df, ["doc_id"]).collect():
        found.setdefault(r.doc_id, set()).add((r.kept, r.base_failed, r.reason))
    assert all(found[k] == {(True, False, None)} for k, *_ in good)
    assert all(not kept for k in junk for kept, _, _ in found[k])
    assert all(found[k] == {(False, True, "base rules")} for k in (903, 904, 905, 906))
    assert found[900] <= {(False, False, "chars_per_token"), (False, False, "byte_share")}
    assert quality_rules(df.limit(0), ["doc_id"]).count() == 0
    page = df.selectExpr("struct(*) AS PAGE", "text", "lang")
    assert quality_rules(page, ["PAGE"]).where("kept").selectExpr("PAGE.*").columns == df.columns


GARBAGE = {
    "chars_per_token": ("zqxjkvwpfgbh#@^~", 7),
    "byte_share": ("\U0001f600\U0001f648\U0001f680\U0001f9ea\U0001fa90", 4),
}


def garbage(rng, kind, n=200):
    letters, size = GARBAGE[kind]
    return " ".join("".join(rng.choice(letters) for _ in range(size)) for _ in range(n))


def kept_keys(spark, rows):
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    return {r.doc_id for r in quality_rules(df, ["doc_id"]).where("kept").collect()}


def invented(rng, n):
    return " ".join(rng.choice(WORDS)[:3] + rng.choice(WORDS)[-4:] for _ in range(n))


@pytest.mark.parametrize("kind", GARBAGE)
def test_a_third_of_garbage_does_not_widen_its_band(spark, kind):
    rng = random.Random(3)
    rows = [(f"good {i}", invented(rng, rng.randint(200, 400)), "xx") for i in range(100)]
    rows += [(f"junk {i}", garbage(rng, kind, rng.randint(150, 300)), "xx") for i in range(50)]
    # As many random letters, which no fixed limit of an unknown language rejects.
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows += [(f"good {i}", invented(rng, rng.randint(200, 400)), "yy") for i in range(100, 200)]
    rows += [
        (f"junk y{i}", " ".join("".join(rng.choice(letters) for _ in range(7)) for _ in range(300)), "yy") for i in range(50)
    ]
    assert kept_keys(spark, rows) == {k for k, *_ in rows if k.startswith("good")}


def test_languages_of_one_text_or_garbage_only(spark):
    rng = random.Random(4)
    rows = [(f"junk {lang} {kind}", garbage(rng, kind), f"{lang}{i}") for i, kind in enumerate(GARBAGE) for lang in ("x", "y")]
    rows += [(f"junk {i}", garbage(rng, "chars_per_token"), "zz") for i in range(20)]
    rows += [("junk none", garbage(rng, "chars_per_token"), None), ("junk few", " ".join(rng.choice("abc") for _ in range(300)), "f")]
    # Random letters in a language whose limit is known, also by its region.
    letters = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(300))
    rows += [("junk en", letters, "en_GB"), ("good en", invented(rng, 300), "en")]
    russian = "Все люди рождаются свободными и равными в своем достоинстве и правах Они наделены разумом и совестью".split()
    rows += [("good ru", " ".join(rng.choice(russian) for _ in range(200)), "ru")]
    assert kept_keys(spark, rows) == {"good en", "good ru"}
