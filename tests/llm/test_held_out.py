"""op10 on the given tables: precision and recall of held-out documents, told apart by whether a learnt word is in them."""

import zlib

import pytest

from conftest import SF
from ragloom.llm import crf, queries

#: Words that half the toxic documents or more share some of; labels of documents without any follow nothing in their text.
WORDS = "trash idiot pathetic worthless scum stupid loser disgusting moron clown".split()


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_toxicity_held_out(spark, sf):
    folder = SF.replace("0.001", sf)
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = {r["doc_id"]: r for r in queries.op10_toxicity(spark, folder).collect()}
    held = [i for i in toxic if i in found and zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i]["held_out"] for i in held)
    right = sum(found[i]["predicted"] and toxic[i] for i in held)
    wrong = sum(found[i]["predicted"] and not toxic[i] for i in held)
    worded = [i for i in held if toxic[i] and {w.lower().strip(crf._TRIM) for w in crf.words_of(texts[i])} & set(WORDS)]
    caught = sum(found[i]["predicted"] for i in worded)
    assert caught >= 0.95 * len(worded) and right >= 0.83 * sum(toxic[i] for i in held) and right / (right + wrong) >= 0.8, (right, wrong, caught, len(worded))
    print(sf, "right", right, "wrong", wrong, "missed", sum(toxic[i] for i in held) - right, "with a word", caught, "of", len(worded))
