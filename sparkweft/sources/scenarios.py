"""A source of scenarios: a folder an agent, in it a folder a scenario, in it the parts.

    scenarios.selected(spark, folder, agent="dba")

The options agent and scenario keep a read to that agent's folder, or to that
scenario's. With the option push, and ``spark.sql.python.filterPushdown.enabled``
true, filters of a query that ask for equality do the same. Neither is the
default: Spark 4.1 keeps what it has pushed into a loaded DataFrame, also for
the next query on it, so each query then needs a DataFrame of its own.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from sparkweft.sources.docsink import open_root

#: The parts that make a scenario, and those that a run leaves.
REQUIRED, MADE = ("input.md", "rubric.md"), ("last_output.md", "last_verdict.json")
SCHEMA = "agent string, scenario string, input string, rubric string, last_output string, last_verdict string"


@dataclass
class OfAgent(InputPartition):
    agent: str


def plain(name: str) -> bool:
    """Whether a folder counts: hidden ones don't."""
    return bool(name) and not name.startswith(".") and "/" not in name


class ScenarioReader(DataSourceReader):
    def __init__(self, root: str, agents_root: str | None = None, agent: str = "", scenario: str = ""):
        self.root, self.agents_root = root, agents_root
        self.wanted: dict[str, set[str]] = {c: {v} for c, v in (("agent", agent), ("scenario", scenario)) if v}

    def partitions(self) -> list[OfAgent]:
        """A partition for each agent that has a folder, and, if there is a folder of agents, a file there."""
        system, base = open_root(self.root)
        if "agent" in self.wanted:
            names = [a for a in self.wanted["agent"] if a and plain(a) and system.get_file_info(f"{base}/{a}").type == fs.FileType.Directory]
        else:
            names = [x.base_name for x in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.type == fs.FileType.Directory and plain(x.base_name)]
        if self.agents_root:
            known, at = open_root(self.agents_root)
            names = [a for a in names if known.get_file_info(f"{at}/{a}.md").type == fs.FileType.File]
        return [OfAgent(a) for a in sorted(names, key=str.encode)]

    def read(self, partition: OfAgent | None) -> Iterator[tuple]:
        if partition is None:  # Spark asks even if there are no partitions
            return
        system, base = open_root(self.root)
        folder = f"{base}/{partition.agent}"
        if "scenario" in self.wanted:
            names = [s for s in self.wanted["scenario"] if s and plain(s)]
        else:
            names = [x.base_name for x in system.get_file_info(fs.FileSelector(folder)) if x.type == fs.FileType.Directory and plain(x.base_name)]
        for name in sorted(names, key=str.encode):
            found = {x.base_name: x for x in system.get_file_info([f"{folder}/{name}/{part}" for part in (*REQUIRED, *MADE)]) if x.type == fs.FileType.File}
            if all(part in found for part in REQUIRED):
                texts = []
                for part in (*REQUIRED, *MADE):
                    if part in found:
                        with system.open_input_stream(found[part].path) as f:
                            texts.append(f.read().decode("utf-8", "replace"))
                    else:
                        texts.append(None)
                yield (partition.agent, name, *texts)


class PushingReader(ScenarioReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equalities of agent and scenario are kept to here; Spark does the rest."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("agent",), ("scenario",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                column = f.attribute[0]
                self.wanted[column] = self.wanted[column] & values if column in self.wanted else values
            else:
                yield f


class Scenarios(DataSource):
    """Scenarios that have all required parts; ``agents_root`` names the folder of agents' files, if only these count."""

    @classmethod
    def name(cls) -> str:
        return "scenarios"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ScenarioReader:
        kind = PushingReader if self.options.get("push", "") == "true" else ScenarioReader
        return kind(self.options["root"], *(self.options.get(k, "") for k in ("agents_root", "agent", "scenario")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Scenarios)


def selected(spark: SparkSession, root: str, agent: str = "", scenario: str = "", agents_root: str = "", push: bool = False) -> DataFrame:
    """The scenarios of that agent and of that name; an empty filter passes all, as in ``report.select_scenarios``."""
    register(spark)
    return spark.read.format("scenarios").options(root=root, agent=agent, scenario=scenario, agents_root=agents_root, push=push).load()
