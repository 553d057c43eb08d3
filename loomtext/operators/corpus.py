"""Documents with fields and how their texts are analysed: what an index is built from."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as T


@dataclass(frozen=True)
class Corpus:
    """Documents with an id and one text column per field, stopwords, a stemmer (none, porter or dictionary) and the rule that cuts tokens (runs or words)."""

    docs: DataFrame
    id: str = "doc_id"
    fields: dict[str, str] = field(default_factory=lambda: {"body": "text"})
    stop: tuple[str, ...] = ()
    possessive: bool = False
    stemmer: str = "none"
    rule: str = "runs"

    @staticmethod
    def documents(spark: SparkSession, sf_dir: str, **options) -> Corpus:
        return Corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), **options)

    def tokens_of(self, name: str) -> Column:
        """Tokens of a field, stopwords included, as their positions count."""
        return T.tokens(F.col(self.fields[name]), possessive=self.possessive, rule=self.rule)

    def tokenised(self, names: list[str] | None = None) -> DataFrame:
        """id and ``tok_<field>`` arrays."""
        return self.docs.select(F.col(self.id).alias("doc_id"), *(self.tokens_of(n).alias(f"tok_{n}") for n in names or self.fields))

    def tokens(self, name: str = "body") -> DataFrame:
        """doc_id, field, pos, term in long form: positions first, stopwords dropped after."""
        long = self.docs.select(F.col(self.id).alias("doc_id"), F.lit(name).alias("field"), F.posexplode(self.tokens_of(name)).alias("pos", "term"))
        return long.filter(~F.col("term").isin(*self.stop)) if self.stop else long
