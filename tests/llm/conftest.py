"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows,
columns whose names clash with results, groups of copies, shared passages."""

import random

import pandas as pd
import pytest

WORDS = ["the", "thion", "erst", "ha", "Inwh", "été", "naïve", "on", "of", "re", "x9", "don't", "日本", "ing", "Ed", "ly"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "a", "er", "st", "."]) + rng.choice(["", "z", "q7"]) for _ in range(n))


def make_documents():
    rng = random.Random(5)
    passage = prose(rng, 60)
    base = prose(rng, 120)
    rows = [(10 + i, prose(rng, rng.randint(1, 150))) for i in range(60)]
    rows += [(100 + i, base) for i in range(25)]
    for i in range(25):
        words = base.split()
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = "changed" + str(rng.random())
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, prose(rng, rng.randint(5, 90)) + "\n" + passage + "\t" + prose(rng, 20)) for i in range(25)]
    rows += [(400, None), (401, ""), (402, " \t\n "), (403, "..."), (404, None), (405, ""), (406, "a"), (407, "A b"), (408, "a b"),
             (409, prose(rng, 20_000)), (410, "ab" * 400), (411, "ab" * 300), (412, "é" * 80), (413, "w " * 120), (414, "w " * 90)]
    rng.shuffle(rows)
    return pd.DataFrame({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows],
                         "lang": [rng.choice(["aa", "bb", None]) for _ in rows], "source": "s", "n_chars": [len(r[1] or "") for r in rows],
                         "score": 7, "kept": "k", "spans": 1, "n_words": -1, "batch": 3})


def make_benchmark(docs):
    rng = random.Random(9)
    texts = docs.set_index("doc_id").text
    some = texts[15].split() or ["x"]
    rows = [(1, " ".join(texts[100].split()[20:50]).upper()), (2, prose(rng, 30)), (3, "a"), (4, None), (5, "..."), (6, prose(rng, 4)),
            (7, " ".join(some[:12])), (11, " ".join(texts[100].split()[30:42])), (None, " ".join(texts[301].split()[-12:])),
            (1, " ".join(texts[100].split()[20:50]).upper())]
    return pd.DataFrame({"item_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows], "extra": 1})


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs = make_documents()
    docs.to_parquet(folder / "documents.parquet", index=False)
    make_benchmark(docs).to_parquet(folder / "benchmark.parquet", index=False)
    rng = random.Random(3)
    vecs = [(i, [rng.uniform(-1, 1) * (1 + i % 7) for _ in range(8)], 1) for i in range(1, 240)]
    vecs += [(300 + i, vecs[4][1], 2) for i in range(30)]
    vecs += [(50, None, 0), (150, [None] * 8, 0), (900, [float("nan")] * 8, 0), (901, [float("inf")] + [0.0] * 7, 0), (250, [1.0, 2.0], 0),
             (100, vecs[99][1], 0)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(str(folder / "embeddings.parquet"))
    chats = []
    marks = ["[INST]", "[/INST]", "</s>", "<s>", "\\", "[SYS]", "[TURN]", "[TEXT]", "\\[INST]", "[\\INST]", "\n", " ", "é", "[", "<"]
    for c in range(40):
        for t in range(rng.randint(1, 7)):
            chats.append((c, t // (1 + c % 2), rng.choice(["user", "assistant", "system", "tool[TEXT]", None]),
                          rng.choice([None, "", "".join(rng.choices(marks, k=rng.randint(1, 9)))])))
    chats += [(90, None, "user", "null turn"), (90, 0, "assistant", "ok"), (91, 0, "user", "same"), (91, 0, "user", "same")]
    spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").write.parquet(str(folder / "conversations.parquet"))
    return str(folder)


@pytest.fixture(scope="session")
def no_rows(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("none")
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"),
                         ("benchmark", "item_id long, text string"), ("embeddings", "vec_id long, embedding array<float>, label int"),
                         ("conversations", "conv_id long, turn long, role string, text string")):
        spark.createDataFrame([], schema).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


@pytest.fixture(scope="session")
def doc_rows(spark, tables):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
