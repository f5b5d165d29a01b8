"""Text to triples by rules: phrases are runs of capitalised words, a triple is phrase, verb phrase, phrase.

The rules need no model files; a better extractor takes the place of ``extract_text`` (text -> triples).
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import confident, named_triples, seeded
from .stats import longest_object, rule_support

PHRASE = r"\p{Lu}[\p{L}\p{N}'-]*(?: \p{Lu}[\p{L}\p{N}'-]*)*"
STRICT = r"(?:[Tt]he )?\p{Lu}[\p{L}\p{N}'-]*(?: \p{Lu}[\p{L}\p{N}'-]*)+"
SENTENCE = r"[.!?\n]+"
_WORD = re.compile(r"[^\W_]+(?:['-][^\W_]+)*")
AUXILIARY = {"is", "was", "are", "were", "has", "had", "have", "be", "been", "will", "would", "can", "could", "did", "does", "do"}
PREPOSITION = {"in", "on", "at", "by", "of", "to", "for", "with", "from", "as", "into", "near", "over", "under"}


def sentences(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, pos, sentence): non-empty sentences with their place."""
    return docs.select(id_column, F.posexplode(F.split("text", SENTENCE)).alias("pos", "sentence")).withColumn("sentence", F.trim("sentence")).where("sentence != ''")


def named_phrases(sentence: DataFrame, mode: str = "named") -> DataFrame:
    """Adds ``phrases``, the runs of capitalised words; ``mode='strict'`` asks for two words, an article before them aside.

    Runs end with the sentence.
    """
    pattern = {"named": PHRASE, "strict": STRICT}[mode]
    found = F.regexp_extract_all("sentence", F.lit(pattern), F.lit(0))
    if mode == "strict":
        found = F.transform(found, lambda x: F.regexp_replace(x, "^[Tt]he ", ""))
    return sentence.withColumn("phrases", F.array_distinct(found))


def extract_text(sentence: str) -> list[tuple[str, str, str, float]]:
    """(subject, predicate, object, confidence) of a sentence.

    A subject is a run of capitalised words; the predicate the words from the next one to the last before the object,
    if it has a verb form (auxiliary, -ed, -s, -ing); the object the next run of capitalised words.
    """
    words = _WORD.findall(sentence)
    runs, i = [], 0
    while i < len(words):
        if words[i][0].isupper():
            j = i
            while j < len(words) and words[j][0].isupper():
                j += 1
            runs.append((i, j))
            i = j
        else:
            i += 1
    out = []
    for (a, b), (c, d) in zip(runs, runs[1:]):
        between = words[b:c]
        if not between:
            continue
        verb = next((w for w in between if w in AUXILIARY or w.endswith(("ed", "ing")) or (w.endswith("s") and len(w) > 3)), None)
        if verb is None:
            continue
        conf = 1.0 if len(between) <= 3 or (between[0] in AUXILIARY and between[-1] in PREPOSITION) else 0.9
        out.append((" ".join(words[a:b]), " ".join(between), " ".join(words[c:d]), conf))
    return out


def extract(sentence: DataFrame, id_column: str = "doc_id", extractor: Callable = extract_text) -> DataFrame:
    """(id, pos, s, p, o, conf) of sentences, with whatever extractor; one that fails on a sentence gives none for it."""

    def run(batches):
        for b in batches:
            rows = []
            for i, pos, text in zip(b[id_column], b["pos"], b["sentence"]):
                try:
                    rows += [(i, pos, *t) for t in extractor(text)]
                except RuntimeError:
                    continue
            yield pd.DataFrame(rows, columns=[id_column, "pos", "s", "p", "o", "conf"])

    kind = sentence.schema[id_column].dataType.simpleString()
    return sentence.select(id_column, "pos", "sentence").mapInPandas(run, f"{id_column} {kind}, pos int, s string, p string, o string, conf double")


def type_triples(entities: DataFrame) -> DataFrame:
    """(s, p, o): name, rdf:type, tag of tagged names (name, tag)."""
    return entities.select(F.col("name").alias("s"), F.lit("rdf:type").alias("p"), F.col("tag").alias("o")).distinct()


def document_triples(docs: DataFrame, entities: DataFrame | None = None, least: float = 0.98, mode: str = "named", id_column: str = "doc_id", extractor: Callable = extract_text) -> DataFrame:
    """(s, p, o): confident triples about named phrases, the longest object of each subject and predicate, and the types
    of tagged names."""
    s = named_phrases(sentences(docs, id_column), mode).where(F.size("phrases") > 0)
    t = extract(s, id_column, extractor).join(s.select(id_column, "pos", "phrases"), [id_column, "pos"])
    out = longest_object(named_triples(t.where(confident(least)))).select("s", "p", "o")
    return out if entities is None else type_triples(entities).unionByName(out)


def with_provenance(triples: DataFrame, docs: DataFrame, id_column: str = "doc_id", ts: str = "ts", url: str = "url") -> DataFrame:
    return triples.join(docs.select(id_column, ts, url), id_column)


def bootstrap_rules(triples: DataFrame, seeds: list[str], by: str = "entity") -> DataFrame:
    """(rule, n): rules of the triples that a seed entity or predicate picks."""
    return rule_support(triples.where(seeded(seeds, ("s", "o") if by == "entity" else ("p",))))


def as_json(sentence: DataFrame, triples: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, json): phrases and triples of each sentence, in order."""
    t = triples.groupBy(id_column, "pos").agg(F.array_sort(F.collect_list(F.struct("s", "p", "o"))).alias("triples"))
    both = sentence.join(t, [id_column, "pos"], "left")
    per = both.groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("pos", "sentence", "phrases", "triples"))).alias("sentences"))
    return per.select(id_column, F.to_json(F.struct("sentences")).alias("json"))
