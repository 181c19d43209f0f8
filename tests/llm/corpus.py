"""A small corpus of awkward documents: nulls, empty and long texts, copies, repeated rows, extra columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, row long, component_id string, n int, word string, score string"


def prose(r, n, words=("the", "and", "thing", "ing", "of", "ther", "ation", "was", "he", "on", "reen", "blest")):
    return " ".join("".join(r.choice(words) for _ in range(r.randint(1, 3))) for _ in range(n)).capitalize() + "."


def texts():
    r = random.Random(5)
    out = [prose(r, r.randint(20, 120)) + "\n" + prose(r, 30) for _ in range(60)]
    out += [out[0], out[0], out[1].replace("the", "tho", 1), out[2] + " end"]  # copies and near copies
    out += [None, "", " \n\t ", "a", "A", "word", "12 34", "É à ß 中文 🙂 x", "one two three", "no letters: 123 !!!" * 2]
    out += [prose(r, 6000), "x" * 70_000, "ab " * 30_000, "\n" * 500 + "end"]
    out += ["mail me at jo.doe@example.org or +1 (017) 555-7713, card 4111 1111 1111 1111, ip 10.0.0.1 and 999.1.1.1", "call (017) 555-7713 or write jo (at) example (dot) org"]
    out += ["*** ### " + prose(r, 40) + "\nSame line here for all of them\n" + prose(r, 3) for _ in range(25)]
    return out


def rows():
    t = texts()
    out = [(i, x, ("en", "de")[i % 2] if i % 7 else None, f"src{i % 3}" if i % 11 else None, len(x or ""), 7, 7, "c", 1, "w", "s") for i, x in enumerate(t)]
    return [*out, out[3], out[3], (None, "a row without an id but with some words in it", None, None, 1, 1, 1, "", 1, "", "")]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
