"""A store of teacher vectors in groups: texts and embeddings by position, attributes beside them, an index of their files.

    rows/group=<name>/...parquet   pos, text, embedding; each file is one range of positions, sorted
    index/                         group, file, first, last, n: one row per file
    attributes/                    one row: the teacher's name, pooling and so on, as a map

Rows are written by Spark's own two-phase commit, then the index from what was written, then the attributes; a store
without attributes isn't one, so a reader never sees a half-written one. Row n of a group is read from the one file
that holds it, found in the index.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.mixing import numbered
from lodestar.sources.sinks import kept

_INDEX = "`group` string, file string, `first` long, `last` long, n long"
_ROWS = "pos long, text string, embedding array<float>, `group` string"
#: Rows of a file, about.
ROWS = 100_000


def write_store(df: DataFrame, path: str, attributes: dict[str, str], rows: int = ROWS) -> None:
    """df: (group, pos long, text, embedding). Positions are distinct within a group; files hold about `rows` rows each."""
    spark = df.sparkSession
    total = df.count()
    out = df.select("group", F.col("pos").cast("long").alias("pos"), F.coalesce("text", F.lit("")).alias("text"), F.col("embedding").cast("array<float>").alias("embedding"))
    out = out.repartitionByRange(max(1, -(-total // rows)), "group", "pos").sortWithinPartitions("group", "pos")
    out.write.partitionBy("group").parquet(f"{path}/rows")
    written = spark.read.schema(_ROWS).parquet(f"{path}/rows")
    index = written.groupBy("group", F.input_file_name().alias("file")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n"))
    index.coalesce(1).write.parquet(f"{path}/index")
    spark.createDataFrame([({k: str(v) for k, v in attributes.items()},)], "attributes map<string, string>").coalesce(1).write.parquet(f"{path}/attributes")


@dataclass
class TeacherStore:
    spark: SparkSession
    path: str

    def attributes(self) -> dict[str, str]:
        """The store's attributes; an error if it isn't complete."""
        try:
            return dict(self.spark.read.parquet(f"{self.path}/attributes").first()["attributes"])
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise ValueError(f"{self.path} isn't a complete teacher store") from e
            raise

    def index(self) -> DataFrame:
        return self.spark.read.schema(_INDEX).parquet(f"{self.path}/index")

    def rows(self, *groups: str) -> DataFrame:
        """(group, pos, text, embedding) of the groups, or of all: other groups' files aren't opened."""
        self.attributes()
        table = self.spark.read.schema(_ROWS).parquet(f"{self.path}/rows")
        return (table.where(F.col("group").isin(list(groups))) if groups else table).select("group", "pos", "text", "embedding")

    def files_of(self, group: str, pos: int) -> list[str]:
        """The files whose range holds the position: one, or none."""
        return [r["file"] for r in self.index().where((F.col("group") == group) & (F.col("first") <= pos) & (F.col("last") >= pos)).collect()]

    def row(self, group: str, pos: int) -> DataFrame:
        """(pos, text, embedding) of one position, from one file."""
        files = self.files_of(group, pos)
        if not files:
            return self.spark.createDataFrame([], "pos long, text string, embedding array<float>")
        return self.spark.read.schema("pos long, text string, embedding array<float>").parquet(*files).where(F.col("pos") == pos)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """(group, pos, text, embedding) of wanted (group, pos): a join, with only the wanted groups' files read."""
        groups = [r["group"] for r in wanted.select("group").distinct().collect()]  # groups are few
        return wanted.select("group", "pos").distinct().join(self.rows(*groups), ["group", "pos"]) if groups else self.rows().limit(0)


def concatenated(stores: list[TeacherStore], group: str, share: float = 0.05) -> DataFrame:
    """(file_no, pos, text, embedding, split): stores one after the other, each with its last int(n * share) rows as val."""
    parts = []
    for i, s in enumerate(stores):
        sizes = s.index().where(F.col("group") == group).agg(F.sum("n").alias("n")).first()["n"] or 0
        placed = numbered(s.rows(group), "pos", "nth")
        split = F.when(F.col("nth") >= sizes - int(sizes * share), "val").otherwise("train")
        parts.append(placed.select(F.lit(i).alias("file_no"), "pos", "text", "embedding", split.alias("split")))
    return reduce(DataFrame.unionByName, parts)


def encoded_store(df: DataFrame, text: str, encode, path: str, attributes: dict[str, str], group: str = "all", rows: int = ROWS) -> TeacherStore:
    """Texts of df, numbered by its order column `pos`, through `encode` (a function of a DataFrame with `text` that adds `vec`), into a store."""
    made = kept(encode(df.select("pos", F.coalesce(F.col(text), F.lit("")).alias("text"))))
    write_store(made.select(F.lit(group).alias("group"), "pos", "text", F.col("vec").alias("embedding")), path, attributes, rows)
    return TeacherStore(df.sparkSession, path)
