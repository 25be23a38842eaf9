"""Documents with everything that may go wrong in them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, size string, shard string, label string, taken string, rank string, kept string"
WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "ing", "ed", ",", "."]) for _ in range(n))


def corpus(seed=1, n=60):
    """(doc_id, text, lang, source) rows: prose, copies, near copies, shared passages, blanks, nulls, a very long text."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(n)]
    passage = prose(rng, 60)
    for i in range(0, n, 5):
        words = texts[i].split(" ")
        if len(words) > 60:
            words[10] = "changed"
        texts.append(" ".join(words))
        texts.append(f"{prose(rng, 5)} {passage} {prose(rng, 7)}")
    texts += [texts[0], texts[0], texts[1], "", "", None, None, "   \n\t ", "one", "One", "one two", "it's  a b   c", "x " * 90, "éß 日本 \U0001f600", "a" * 70_000 + " " + passage, "123 ... !!"]
    rows = [(i, t, rng.choice(["en", "fr"]), rng.choice(["s1", "s2", "s3", None])) for i, t in enumerate(texts)]
    rows[3] = (3, texts[3], None, "s1")
    rows.append((len(rows), texts[2], "en", "s1"))
    return rows


def frame(spark, rows):
    full = [(i, t, lang, source, len(t) if t else None, 7, "k", "big", "s", None, None, "r", None) for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def awkward(rows):
    """rows and more: a repeated row, a repeated id with another text, null ids."""
    return [*rows, rows[4], (rows[5][0], "another text under a used id", "en", "s2"), (None, "no id at all", "en", None), (None, None, None, None), (None, rows[6][1], rows[6][2], "s1")]
