"""Entity titles and page texts over HTTP: batches of ids per request, retries with back-off, a rate per task, failures as rows.

Requests are made by the tasks that hold the ids, so a lost task asks again only for its own. What was fetched is
written before it is used; a later run passes it as `known` and asks only for what is missing or failed.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import entity_id
from lodestar.sources.sinks import kept

AGENT = "lodestar/1.0"
#: Answers after which a request is tried again.
AGAIN = (429, 500, 502, 503, 504)


@dataclass(frozen=True)
class Service:
    """An endpoint and how it may be asked: ids per request, tries, seconds before the second try (doubled each time), requests per second and task."""

    url: str
    batch: int = 50
    tries: int = 6
    pause: float = 1.0
    timeout: float = 10.0
    per_second: float | None = None

    def get(self, params: dict[str, str]) -> dict:
        """The JSON object of an answer. Raises what the last try raised."""
        request = urllib.request.Request(f"{self.url}?{urllib.parse.urlencode(params)}", headers={"User-Agent": AGENT})
        for n in range(self.tries):
            began = time.monotonic()
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310  the caller names the address
                    return json.loads(answer.read().decode("utf-8"))
            except urllib.error.HTTPError as e:
                if e.code not in AGAIN or n + 1 == self.tries:
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if n + 1 == self.tries:
                    raise
            finally:
                if self.per_second:
                    time.sleep(max(0.0, 1 / self.per_second - (time.monotonic() - began)))
            time.sleep(self.pause * 2**n)
        raise AssertionError("unreachable")


def _short(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:200]


def _asked(keys: DataFrame, key: str, known: DataFrame | None, answer: str) -> DataFrame:
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    return wanted if known is None else wanted.join(known.where(F.col(answer).isNotNull()).select(key), key, "left_anti")


def _with_known(got: DataFrame, known: DataFrame | None, answer: str) -> DataFrame:
    got = kept(got)
    return got if known is None else got.unionByName(known.where(F.col(answer).isNotNull()).select(*got.columns))


def titles(ids: DataFrame, service: Service, known: DataFrame | None = None, site: str = "enwiki") -> DataFrame:
    """(qid, title, error) of distinct ids (a column qid): one request per `batch` ids; an id without a page has no title and no error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            every = f["qid"].tolist()
            for lo in range(0, len(every), service.batch):
                part = every[lo : lo + service.batch]
                try:
                    found = service.get({"action": "wbgetentities", "ids": "|".join(part), "props": "sitelinks", "sitefilter": site, "format": "json"}).get("entities", {})
                    yield pd.DataFrame({"qid": part, "title": [found.get(q, {}).get("sitelinks", {}).get(site, {}).get("title") for q in part], "error": None})
                except Exception as e:  # a batch that fails is a row per id, and the others go on
                    yield pd.DataFrame({"qid": part, "title": None, "error": _short(e)})

    return _with_known(_asked(ids, "qid", known, "title").mapInPandas(run, "qid string, title string, error string"), known, "title")


def pages(names: DataFrame, service: Service, known: DataFrame | None = None) -> DataFrame:
    """(title, page, error) of distinct titles (a column title): plain text of each page, null for one that isn't there."""

    def one(title: str) -> tuple[str | None, str | None]:
        try:
            got = service.get({"action": "query", "format": "json", "titles": title, "prop": "extracts", "explaintext": "1", "exintro": "0", "redirects": "1"})
        except Exception as e:
            return None, _short(e)
        for number, page in got.get("query", {}).get("pages", {}).items():
            if int(number) < 0:
                return None, None
            if "extract" in page:
                return page["extract"], None
        return None, None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [one(t) for t in f["title"]]
            yield pd.DataFrame({"title": f["title"], "page": [p for p, _ in got], "error": [e for _, e in got]})

    return _with_known(_asked(names, "title", known, "page").mapInPandas(run, "title string, page string, error string"), known, "page")


def enriched(qa: DataFrame, entities: Service, texts: Service, known_titles: DataFrame | None = None, known_pages: DataFrame | None = None) -> DataFrame:
    """qa (s_uri, o_uri, and if it has them s_wiki_title, o_wiki_title) with titles, page texts and errors of subject and object.

    A title found by the entity's number goes before the one in the row.
    """
    numbers = qa.select(F.explode(F.array(entity_id(F.col("s_uri")), entity_id(F.col("o_uri")))).alias("qid"))
    named = titles(numbers, entities, known_titles)
    out = qa
    for side in ("s", "o"):
        old = F.col(f"{side}_wiki_title") if f"{side}_wiki_title" in qa.columns else F.lit(None).cast("string")
        t = named.select(F.col("qid").alias("_q"), F.col("title").alias("_t"), F.col("error").alias("_e"))
        out = out.withColumn("_k", entity_id(F.col(f"{side}_uri"))).join(t, F.col("_k") == F.col("_q"), "left")
        out = out.withColumn(f"{side}_wiki_title", F.coalesce("_t", old)).withColumn(f"{side}_error", F.col("_e")).drop("_k", "_q", "_t", "_e")
    out = kept(out)
    read = pages(out.select(F.explode(F.array("s_wiki_title", "o_wiki_title")).alias("title")), texts, known_pages)
    for side in ("s", "o"):
        p = read.select(F.col("title").alias("_t"), F.col("page").alias("_p"), F.col("error").alias("_e"))
        out = out.join(p, F.col(f"{side}_wiki_title") == F.col("_t"), "left").withColumn(f"{side}_wiki_content", F.col("_p")).withColumn(f"{side}_error", F.coalesce(f"{side}_error", "_e")).drop("_t", "_p", "_e")
    return out
