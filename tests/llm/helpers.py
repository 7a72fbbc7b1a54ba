"""Documents with every odd case, and columns whose names clash with results."""

import random

ODD = [None, "", " ", "\n", "\n\n", "a", "A b", "\t \x0b", "a  b\n c ", "日本語 テキスト", "🙂", "x" * 5000, "word " * 3000, "<|endoftext|> a <s> b", "\x00\x1c\x1f\x85\xa0 z", "▁a ▁▁ b", "it's  we'll\n\n  end  "]


def odd_documents(spark, more=()):
    """doc_id from 1, each text once, the last repeated; extra columns bear names of results."""
    texts = [*ODD, *more]
    rows = [(i + 1, t, "en" if i % 2 else None, 7, True) for i, t in enumerate(texts)]
    rows.append((len(rows) + 1, texts[-1], "en", 7, True))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, N_Tokens int, kept boolean")


def fuzz(n, seed=1):
    rng = random.Random(seed)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "'s", "'", "ll", "<|endoftext|>", "1", "日", "🙂", "\x1c", "\x85", "　", "\xa0", "!", "#", "\x00", "ß", "x", "​", " y", " foo", " bar.", "▁", "</s>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]
