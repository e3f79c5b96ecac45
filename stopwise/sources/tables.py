"""Access to the base tables and the views built on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.operators.clean import with_delays
from stopwise.operators.graph import build_edge_table
from stopwise.session import fresh_path
from stopwise.sources.files import write_by_date
from stopwise.sources.stand_ins import render

BASE = ("region nation customer supplier part orders lineitem events documents "
        "embeddings pages benchmark labels conversations").split()

_STORED: dict[tuple, str] = {}


class Tables:
    """Lazy frames over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._files: tuple | None = None

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str, needs: str) -> DataFrame:
        return self.spark.sql(render(name, "spark").replace(f"FROM {needs}", "FROM {" + needs + "}"),
                              **{needs: self.base(needs)})

    def stored_path(self, name: str, make: Callable[[], DataFrame], write: Callable[[DataFrame, str], object] | None = None) -> str:
        """A folder written once per application and state of the input files, as a feed or a nightly refresh would.
        Spark spreads the rows over files of even size."""
        key = (self.spark.sparkContext.applicationId, self.folder, self.files(), name)
        if key not in _STORED:
            path = fresh_path(self.spark, name)
            if write:
                write(make(), path)
            else:
                make().hint("rebalance").write.parquet(path)
            _STORED[key] = path
        return _STORED[key]

    def stored(self, name: str, make: Callable[[], DataFrame], write: Callable[[DataFrame, str], object] | None = None) -> DataFrame:
        return self.spark.read.parquet(self.stored_path(name, make, write))

    def files(self) -> tuple:
        """Number, size and latest change of the input files; the file system lists them, no job runs."""
        if self._files is None:
            context = self.spark.sparkContext
            root = context._jvm.org.apache.hadoop.fs.Path(self.folder)
            listed = root.getFileSystem(context._jsc.hadoopConfiguration()).listFiles(root, True)
            number = size = changed = 0
            while listed.hasNext():
                file = listed.next()
                number, size, changed = number + 1, size + file.getLen(), max(changed, file.getModificationTime())
            self._files = number, size, changed
        return self._files

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        raise AttributeError(name)

    @property
    def stops(self) -> DataFrame:
        """The stop-event table: all events in the shape of stops, stored as Parquet."""
        return self.stored("stops", lambda: self.view("stops", "events"))

    @property
    def stops_by_date(self) -> DataFrame:
        """The stop-event table in folders by date."""
        return self.stored("stops_by_date", lambda: self.stops, write_by_date)

    @property
    def delayed(self) -> DataFrame:
        """The refreshed table: stops with platform, delays and the happened / cancelled flags."""
        return self.stored("delayed", lambda: with_delays(self.stops))

    @property
    def stations(self) -> DataFrame:
        return self.view("stations", "supplier")

    @property
    def points(self) -> DataFrame:
        return self.view("points", "customer")

    @property
    def edges(self) -> DataFrame:
        return self.view("edges", "lineitem")

    @property
    def edge_table(self) -> DataFrame:
        """The edges of the network with their numbers, stored once for all that ask for paths."""
        return self.stored("edge_table", lambda: build_edge_table(self.edges))

    @property
    def tracks(self) -> DataFrame:
        return self.view("tracks", "customer")

    @property
    def track_types(self) -> DataFrame:
        return self.view("track_types", "customer")

    @property
    def works(self) -> DataFrame:
        return self.view("works", "orders")
