"""Token counts as delta-maintained rollups by source, language and tokenizer version.

Changes are signed: an insert adds a document and its tokens, a delete takes them back, a revision adds the difference of
two counts. Totals are sums, so a batch is folded to one row per group before it is stored, whatever its size or skew,
and totals never read documents again. A batch is committed with its id by one rename of a manifest; an id that is already
there changes nothing, so batches can be sent again after any failure.
"""
from __future__ import annotations

import json
import uuid

import pyarrow as pa
import tiktoken
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetweave.llm.byte_bpe import read_ranks
from fleetweave.llm.text import texts_of

KEYS = ["source", "lang", "tokenizer_version"]
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


_encoders: dict = {}  # of this task's process


def _encoder(version: str, table: dict[bytes, int], pattern: str, run: str):
    if (run, version) not in _encoders:
        encoding = tiktoken.Encoding(version, pat_str=pattern, mergeable_ranks=table, special_tokens={})
        _encoders[run, version] = encoding.encode_ordinary
    return _encoders[run, version]


def counted(docs: DataFrame, tokenizers: dict[str, tuple[str, str]], text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """Every row once per tokenizer version, with ``tokenizer_version`` and its token count; other columns pass through.

    ``tokenizers`` maps versions to (rank file, pattern). Whole texts are counted; a null text has 0 tokens.
    """
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    ranks = docs.sparkSession.sparkContext.broadcast({v: (read_ranks(p), pattern) for v, (p, pattern) in tokenizers.items()})
    this = uuid.uuid4().hex
    kept = [f for f in docs.schema if f.name not in ("tokenizer_version", name, text_col)]
    schema = StructType([*kept, StructField("tokenizer_version", StringType()), StructField(name, LongType())])
    places, text_place = [docs.columns.index(f.name) for f in kept], docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [t.decode() for t in texts_of(batch.column(text_place))]
            for version in ranks.value:
                encode = _encoder(version, *ranks.value[version], this)
                counts = pa.array([len(encode(t)) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in places], pa.array([version] * len(texts)), counts],
                                                 names=schema.names)

    return docs.mapInArrow(run, schema)


def signed(changes: DataFrame) -> DataFrame:
    """Fold changes to one row per group: (source, lang, tokenizer_version, n_docs, n_tokens), both counts signed.

    ``changes`` has the keys, ``op`` (insert, delete or revise), ``n_tokens`` and ``old_tokens``. An insert counts
    ``n_tokens``, a delete takes ``old_tokens`` back, a revision does both and counts no document; a change of source,
    language or version is a delete and an insert. Null counts are 0, null keys are a group of their own, and rows of any
    other ``op`` change nothing. Repeated rows count as often as they stand there.
    """
    op = F.col("op")
    new = F.when(op.isin("insert", "revise"), F.coalesce("n_tokens", F.lit(0))).otherwise(0)
    old = F.when(op.isin("delete", "revise"), F.coalesce("old_tokens", F.lit(0))).otherwise(0)
    docs = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0)
    return changes.where(op.isin("insert", "delete", "revise")).groupBy(*[F.col(k).cast("string").alias(k) for k in KEYS]).agg(
        F.sum(docs).cast("long").alias("n_docs"), F.sum(new - old).cast("long").alias("n_tokens"))


class Rollup:
    """Totals kept in a folder: folded batches as immutable tables below ``data``, and numbered manifests that list them.

    The manifest of the highest number is the state: its tables, the ids of all batches they hold, and tables that an
    earlier compaction replaced. A change writes its table first and then the next manifest, by one rename that fails if
    that number is taken; a writer that loses reads the winner's manifest and tries again. A crash before the rename leaves
    a table that no manifest lists; after it, at most files to delete. Readers hold one manifest's tables, which stay for
    one more compaction.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._at().getFileSystem(conf)
        self._renames = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), conf)

    def _at(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _numbers(self) -> list[int]:
        """Numbers of the manifests, ascending."""
        if not self._files.exists(self._at("manifests")):
            return []
        return sorted(int(n) for s in self._files.listStatus(self._at("manifests")) if (n := s.getPath().getName()).isdigit())

    def _state(self) -> tuple[int, dict]:
        numbers = self._numbers()
        if not numbers:
            return 0, {"tables": [], "ids": [], "retired": []}
        reader = self._jvm.org.apache.commons.io.IOUtils
        stream = self._files.open(self._at("manifests", str(numbers[-1])))
        try:
            return numbers[-1], json.loads(reader.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, number: int, state: dict) -> bool:
        """Make a state the manifest of this number; False if there is one already."""
        draft = self._at("manifests", f"draft-{uuid.uuid4().hex}")
        stream = self._files.create(draft, False)
        try:
            stream.write(json.dumps(state).encode())
        finally:
            stream.close()
        never = self._jvm.org.apache.hadoop.fs.Options.Rename
        flags = self.spark.sparkContext._gateway.new_array(never, 1)
        flags[0] = getattr(never, "NONE")
        try:
            self._renames.rename(draft, self._at("manifests", str(number)), flags)
        except Py4JJavaError:
            self._files.delete(draft, False)
            if not self._files.exists(self._at("manifests", str(number))):
                raise
            return False
        return True

    def _written(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self._files.delete(self._at("data", name), True)

    def _tidy(self, number: int) -> None:
        """Delete manifests before the last two: one may be in a reader's hands."""
        for old in self._numbers():
            if old < number - 1:
                self._files.delete(self._at("manifests", str(old)), False)

    def committed(self, batch_id: str) -> bool:
        return batch_id in self._state()[1]["ids"]

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of changes; False, and nothing done, if its id has been committed before."""
        number, state = self._state()
        if batch_id in state["ids"]:
            return False
        name = self._written(signed(changes))
        while batch_id not in state["ids"]:
            if self._publish(number + 1, state | {"tables": [*state["tables"], name], "ids": [*state["ids"], batch_id]}):
                self._tidy(number + 1)
                return True
            number, state = self._state()
        self._drop([name])
        return False

    def _sums(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], DELTA)
        rows = self.spark.read.schema(DELTA).parquet(*[f"{self.path}/data/{n}" for n in names])
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens) over all committed batches, without empty groups."""
        return self._sums(self._state()[1]["tables"]).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> bool:
        """Fold all tables into one; ids stay known, so sending a batch again still does nothing.

        The tables that this replaces are deleted by the next compaction. False if there was nothing to fold, or if
        another writer was faster.
        """
        number, state = self._state()
        if len(state["tables"]) < 2:
            return False
        name = self._written(self._sums(state["tables"]))
        if not self._publish(number + 1, {"tables": [name], "ids": state["ids"], "retired": state["tables"]}):
            self._drop([name])
            return False
        self._drop(state["retired"])
        self._tidy(number + 1)
        return True
