"""Small tables with the awkward cases every operator must take, and helpers for brute-force checks."""

import random

from pyspark.sql import types as T

#: Helper columns of operators, as an input may call its own.
CLASHES = ("_at", "_part", "_p", "_first", "_before", "_g0", "_n", "_s", "_each", "_start", "_tie", "_turn", "_permuted", "_mix_group", "rank", "toks")

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("kept", T.StringType()),  # names that operators use themselves
        T.StructField("size", T.StringType()),
        T.StructField("_place", T.StringType()),
        T.StructField("shard", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in CLASHES],
    ]
)


def prose(seed, n, vocabulary=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


def awkward_texts():
    long = prose(3, 4000, 900)
    base = prose(5, 90, 80)
    near = base.replace(base.split()[40], "zzz", 1)
    return [
        None, "", " \n\t ", "one", "A\nA\nB\n\nA", base, base, near, base + "\n" + base, long, long + " end",
        "x " * 100, "ab cd " * 60, "É　 ñ a\x0bb\x0cc\rd", "##$ %%% &|<>" * 9, prose(9, 19), prose(10, 20), prose(11, 12), "日本語の文" * 30,
        prose(12, 60) + "\n" + " ".join(base.split()[10:45]) + "\n" + prose(13, 50),
    ]


def docs(spark, texts=None, sources=("s1", "s0", None), repeat=True):
    texts = awkward_texts() if texts is None else texts
    data = [
        (i * 3 % 101 if t is not None else i, t, None if i % 7 == 0 else ("en", "de")[i % 2], sources[i % len(sources)], i, "k", "z", "p", "h", *CLASHES)
        for i, t in enumerate(texts)
    ]
    if repeat and data:
        data += [data[5], (None, data[5][1], "en", "s1", None, None, None, None, None, *CLASHES)]
    return spark.createDataFrame(data, DOCS)
