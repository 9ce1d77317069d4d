"""Text functions as column expressions. Null text is empty text throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Instruction prefixes of teacher models, by kind.
TEACHER_PREFIX = {
    "query": "query: ",
    "passage": "passage: ",
    "instruct": "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery: ",
    "none": "",
}


def _text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def word_tokens(c: Column | str) -> Column:
    """Lower-cased runs of Unicode word characters (F1)."""
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(r"((?U)\w+)"), F.lit(1))


def space_tokens(c: Column | str) -> Column:
    """Lower-cased pieces between white space (F2)."""
    return F.filter(F.split(F.lower(_text(c)), r"(?U)\s+"), lambda x: x != "")


def normalized(c: Column | str) -> Column:
    """Lower case, no punctuation, single spaces, no outer space."""
    bare = F.regexp_replace(F.lower(_text(c)), r"(?U)[^\w\s]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+", " "), "^ | $", "")


def is_blank(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), r"(?U)\s+", "") == ""


def contains_any(prediction: Column, references: Column) -> Column:
    """Whether any normalised reference is part of the normalised prediction (F4). An empty reference is; without references false."""
    return F.coalesce(F.exists(references, lambda r: F.contains(normalized(prediction), normalized(r))), F.lit(False))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays' sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def overlap(reference: Column, candidate: Column) -> Column:
    """Share of the reference's distinct tokens that the candidate has."""
    return F.size(F.array_intersect(reference, candidate)) / F.greatest(F.size(F.array_distinct(reference)), F.lit(1))


def length_ratio(reference: Column, candidate: Column) -> Column:
    return F.size(candidate) / F.greatest(F.size(reference), F.lit(1))


def shortened(c: Column | str, n: int = 200) -> Column:
    """The first n characters, for tables of examples."""
    return F.substring(_text(c), 1, n)


def conditioned(document: Column, query: Column | None) -> Column:
    """A document's text as an encoder that knows the query reads it (V4); the plain text if there is no query."""
    if query is None:
        return _text(document)
    return F.when(query.isNull(), _text(document)).otherwise(F.concat(F.lit("Q: "), query, F.lit("\nD: "), _text(document)))


def slug(c: Column | str) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made == "", "run").otherwise(made)


def entity_id(uri: Column | str) -> Column:
    """Q-number of an entity URI, else null."""
    return F.nullif(F.regexp_extract(_text(uri), r"entity/(Q\d+)", 1), F.lit(""))


def unix_lines(c: Column | str) -> Column:
    return F.replace(_text(c), F.lit("\r\n"), F.lit("\n"))


def prompt(template: str, document: Column, question: Column | None = None) -> Column:
    """A template's {document} and {question} filled in (F27); a blank template is the document itself."""
    if not template.strip():
        return _text(document)
    out = F.replace(F.lit(template), F.lit("{document}"), _text(document))
    return F.replace(out, F.lit("{question}"), _text(question)) if question is not None else out


def titled_document(title: Column, sentences: Column) -> Column:
    """"title: sentences", null if there is no sentence (F32)."""
    return F.when(F.size(sentences) > 0, F.concat(_text(title), F.lit(": "), F.array_join(sentences, " ")))


def chosen_template(templates: list[str], key: Column, seed: int = 0) -> Column:
    """A template picked by the key's hash: the same for the same key and seed."""
    spot = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*[F.lit(t) for t in templates]), (F.pmod(spot, F.lit(len(templates))) + 1).cast("int"))


def sentence_chunks(text: Column, words: int = 350) -> Column:
    """Sentences joined into about words-long chunks (F33): n = words // 350 + 1 chunks of max(sentences // n, 1) sentences."""
    sents = F.filter(F.split(_text(text), r"(?<=[.!?])(?U)\s+"), lambda s: s != "")
    n = F.floor(F.size(space_tokens(text)) / words) + 1
    each = F.greatest(F.floor(F.size(sents) / n), F.lit(1)).cast("int")
    starts = F.when(F.size(sents) > 0, F.sequence(F.lit(0), F.size(sents) - 1, each)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(sents, i + 1, each), " "))


def hash_order(key: Column, seed: str | int) -> Column:
    """A reproducible random order, equal in every engine that has MD5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
