"""Small tables with every odd case: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, d int, h int, k int, row string, spans string, key string, id string, r int, label int, `cluster` int"


def odd_rows():
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "ba de ki lo Mu né".split() for b in "ra te SO wü pin".split()]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage, line = prose(120), prose(60), prose(8)
    near = base.split()
    near[60] = "changed"
    lines = "\n".join([line, prose(7), line, line + "x", "short", "short", line[:-1], prose(9)])
    texts = {
        1: base, 2: base, 3: " ".join(near), 4: None, 5: "", 6: " \n\t ", 7: "one", 8: "one", 9: prose(30) + " " + passage + " " + prose(30),
        10: prose(20) + "\n" + passage + "\t" + prose(40), 11: "word " * 3000, 12: prose(5000), 13: lines, 14: lines.replace("short", "other") + "\r",
        15: "x" * 70_000, 16: "éàü 　   𝔘𝔫 <|endoftext|> ' s 123456 \n\n  end", 17: "# * $ % & | < > " * 10, 18: passage + " " + passage, 19: prose(2), 20: prose(2).upper(),
    }
    return list(texts.items())


def odd_docs(spark, extra=()):
    rows = [*odd_rows(), *extra]
    return spark.createDataFrame([(i, t, "xx", 1, 2, 3, "a", "b", "c", "e", 4, 5, 6) for i, t in rows], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
