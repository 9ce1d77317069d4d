"""Question-answering sources as uniform chat records: {id, task_type, messages, background}.

Each mapping is one select from its source's shape; `mix` unions, keeps the first of an id and orders by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import chosen_template, hash_order, is_blank, unix_lines
from lodestar.operators.mixing import first_by, pair_messages, turn_messages

OPEN, CLOSE, SUMMARY, FACT = "open_qa", "close_qa", "summarization", "fact_checking"
#: Prompt wordings of our own; the placeholder is the question.
QUESTION_FORMS = ["{question}", "Question: {question}", "Please answer: {question}", "{question}\nAnswer:", "Answer the following question. {question}"]
SUMMARY_FORMS = ["Summarize the text.", "Write a short summary.", "What is this text about?", "Give the main points."]
FACT_FORM = "Is the following claim true or false? {claim}"


def asked(question: Column, key: Column, seed: int = 0) -> Column:
    return F.trim(F.replace(chosen_template(QUESTION_FORMS, key, seed), F.lit("{question}"), F.coalesce(question, F.lit(""))))


def first_answer(answers: Column, default: str = "") -> Column:
    return F.coalesce(F.get(answers, F.lit(0)), F.lit(default))


def _record(df: DataFrame, prefix: str, pos: str, task: str, messages: Column, background: Column | None = None) -> DataFrame:
    return df.select(
        F.concat(F.lit(f"{prefix}_"), F.col(pos).cast("string")).alias("id"),
        F.lit(task).alias("task_type"),
        messages.alias("messages"),
        (F.lit(None).cast("string") if background is None else background).alias("background"),
    )


def short_answer(df: DataFrame, prefix: str, pos: str = "pos", question: str = "question", answers: str = "answers", background: str | None = None, no_answer: str = "") -> DataFrame:
    """Sources with a question and a list of answers: the first counts."""
    m = pair_messages(asked(F.col(question), F.col(pos)), first_answer(F.col(answers), no_answer))
    return _record(df, prefix, pos, CLOSE if background else OPEN, m, F.col(background) if background else None)


def labelled_pairs(df: DataFrame, prefix: str, pos: str = "pos", limit: int | None = None) -> DataFrame:
    """Sources of (question, answer, label): label 1 only; a limit counts kept rows, ids keep the original position."""
    kept = df.where("label = 1")
    kept = kept.orderBy(pos).limit(limit) if limit is not None else kept
    return _record(kept, prefix, pos, OPEN, pair_messages(asked(F.col("question"), F.col(pos)), F.col("answer")))


def _options(labels: Column, texts: Column) -> Column:
    return F.array_join(F.zip_with(labels, texts, lambda a, b: F.concat(a, F.lit(". "), F.coalesce(b, F.lit("")))), "\n")


def multiple_choice(df: DataFrame, prefix: str, pos: str = "pos") -> DataFrame:
    """(question, choices{label, text}, answerKey): the options are listed, the answer is the key."""
    q = F.concat(F.coalesce("question", F.lit("")), F.lit("\n"), _options(F.col("choices.label"), F.col("choices.text")))
    return _record(df, prefix, pos, OPEN, pair_messages(asked(q, F.col(pos)), F.col("answerKey")))


def index_choice(df: DataFrame, prefix: str, pos: str = "pos") -> DataFrame:
    """(question, answers, correct_answer_id, context): the first four answers as A-D, an index out of range is A."""
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    four = F.slice("answers", 1, 4)
    q = F.concat(F.coalesce("question", F.lit("")), F.lit("\n"), _options(F.slice(letters, F.lit(1), F.size(four)), four))
    i = F.col("correct_answer_id")
    return _record(df, prefix, pos, CLOSE, pair_messages(asked(q, F.col(pos)), F.element_at(letters, F.when(i.between(0, 3), i + 1).otherwise(1))), F.col("context"))


def conversational(df: DataFrame, prefix: str, pos: str = "pos") -> DataFrame:
    """(story, questions, answers{input_text}): alternating turns, only the first is put in a prompt form; unequal lengths go."""
    qs = F.transform("questions", lambda q, i: F.when(i == 0, asked(q, F.col(pos))).otherwise(q))
    return _record(df.where(F.size("questions") == F.size("answers.input_text")), prefix, pos, CLOSE, turn_messages(qs, F.col("answers.input_text")), F.col("story"))


def summaries(df: DataFrame, prefix: str, pos: str = "pos", text: str = "dialogue", summary: str = "summary") -> DataFrame:
    """Background is the text with plain line ends; blank texts go."""
    body = F.trim(unix_lines(text))
    return _record(df.where(~is_blank(text)), prefix, pos, SUMMARY, pair_messages(chosen_template(SUMMARY_FORMS, F.col(pos)), F.col(summary)), body)


def claims(df: DataFrame, prefix: str, pos: str = "pos") -> DataFrame:
    """(claim, label, evidence): 'supports' in any case is True."""
    m = pair_messages(F.replace(F.lit(FACT_FORM), F.lit("{claim}"), F.coalesce("claim", F.lit(""))), F.when(F.lower("label") == "supports", "True").otherwise("False"))
    return _record(df, prefix, pos, FACT, m, F.col("evidence"))


def long_answer(df: DataFrame, prefix: str, pos: str = "pos") -> DataFrame:
    """(question, contexts, long_answer, final_decision): the answer ends with the decision."""
    m = pair_messages(asked(F.col("question"), F.col(pos)), F.concat(F.coalesce("long_answer", F.lit("")), F.lit(" "), F.coalesce("final_decision", F.lit(""))))
    return _record(df, prefix, pos, CLOSE, m, F.array_join("contexts", " "))


#: Which shape each known kind of source has.
LOADERS = {
    "commonsense_qa": multiple_choice, "web_questions": short_answer, "wiki_qa": labelled_pairs, "yahoo_answers_qa": short_answer, "freebase_qa": short_answer,
    "ms_marco": short_answer, "coqa": conversational, "drop": short_answer, "narrativeqa": short_answer, "triviaqa": short_answer, "fm2": claims, "nq_open": short_answer,
    "pwc": short_answer, "dialogsum": summaries, "samsum": summaries, "cnn_dailymail": summaries, "squad_v2": short_answer, "quail": index_choice, "pubmed_qa": long_answer,
}


def mix(sources: list[DataFrame], seed: int = 42) -> DataFrame:
    """All records, the first of each id, in hash order (column `order`)."""
    out = None
    for i, s in enumerate(sources):
        part = s.select("*", F.lit(i).alias("_source"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no sources")
    return first_by(out, "id", "_source").drop("_source").withColumn("order", hash_order(F.col("id"), seed))
