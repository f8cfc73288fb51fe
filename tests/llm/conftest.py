import random
import re

import pytest
from pyspark.sql import functions as F


def _norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


class Brute:
    """Plain versions of what the operators share."""

    BIG = 1 << 60

    @staticmethod
    def words(text):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall("[^\x20\x09-\x0d]+", lower)

    normalised = staticmethod(_norm)

    @staticmethod
    def roots(n, links):
        """Smallest member of every element's component."""
        parent = list(range(n))

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i
        for a, b in links:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return [find(i) for i in range(n)]


@pytest.fixture(scope="session")
def brute():
    return Brute


@pytest.fixture(scope="session")
def texts():
    """Texts of every kind: prose, copies, near copies, missing, blank, empty, very long, other scripts."""
    rnd = random.Random(5)
    vocabulary = [["the", "of", "rain", "house", "river", "walks", "stone", "light", "green", "under", "Over", "seven"],
                  ["der", "die", "haus", "fluss", "gehen", "stein", "licht", "grün", "unter", "über", "sieben", "und"]]
    out = []
    for k in range(60):
        words = [rnd.choice(vocabulary[k % 2]) for _ in range(rnd.choice([1, 3, 4, 40, 200]))]
        out.append(" ".join(words))
    out += out[10:20] + [out[3].replace(" ", "\n\t"), out[7] + " "]
    long = " ".join(rnd.choice(vocabulary[0]) + str(k % 97) for k in range(30000))
    out += [long, long + " end", long.upper(), "x" * 40000, "", None, None, " ", " \t\n ", "\x0b", "...", "12 34", "日本語 テキスト", "don't 'S ½ é́ ß İ",
            "a b c", "A  b\nC", "🙂🙂 <|endoftext|> x<|endoftext|>"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Rows with repeated and missing ids and columns whose names operators use themselves."""
    rows = [(None if k % 31 == 30 else k - k % 7 // 6, t, ["en", "de", None][k % 2 if k % 13 else 2], k) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n int")
    for name in ("row", "words", "names", "print", "n_tokens", "part", "nth", "score", "kept", "cell"):
        df = df.withColumn(name, F.lit(name))
    return df.repartition(3, "n")


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.filter("n < 0")
