"""A whole analysis: files and modules in, every report out."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline import schema
from seamline.operators.bounds import partitions_for, settle
from seamline.operators.chunks import LARGE_BYTES
from seamline.operators.packages import file_facts, loc
from seamline.plans import report
from seamline.plans.ordering import PAGE_ROWS, detail_pages, in_walk_order
from seamline.plans.occurrences import occurrences, unique_counts
from seamline.plans.shared_texts import shared_occurrences
from seamline.plans.versions import version_delta


class Analysis:
    """Reports over one set of files.

    The text is read twice, whatever is asked for: once for the facts about each file and once for
    the occurrences. Both results are far smaller than the text and are computed once.

    ``modules`` has module, version, dependants; reports without it need no modules. With ``share_texts`` files with equal text
    are analysed once, which is for several versions of the same modules.
    """

    def __init__(self, files: DataFrame, modules: DataFrame | None = None, *,
                 exec_rules: DataFrame | None = None, partitions: int | None = None, share_texts: bool = False):
        self._share_texts = share_texts
        self.files, self.modules = files, modules
        self._exec_rules, self._partitions = exec_rules, partitions

    @cached_property
    def facts(self) -> DataFrame:
        return settle(file_facts(self.files))

    @cached_property
    def placed(self) -> DataFrame:
        """Occurrences with their places in the tree."""
        if self._share_texts:
            return settle(shared_occurrences(self.files, facts=self.facts, exec_rules=self._exec_rules, places=True))
        return settle(occurrences(
            self.files, facts=self.facts, exec_rules=self._exec_rules, partitions=self._text_partitions(),
            large_bytes=LARGE_BYTES if self._volume[1] >= LARGE_BYTES else None, places=True))

    @property
    def occurrences(self) -> DataFrame:
        return self.placed.select(schema.OCCURRENCE_COLUMNS)

    @cached_property
    def ordered(self) -> DataFrame:
        """Occurrences numbered within their lists, in the order of a walk over the tree."""
        return in_walk_order(self.placed)

    def detail_pages(self, page_rows: int = PAGE_ROWS) -> DataFrame:
        return detail_pages(self.ordered, page_rows)

    @cached_property
    def _volume(self) -> tuple[int, int]:
        """Bytes of all text and of the largest file, which the facts tell."""
        return tuple(self.facts.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first())

    def _text_partitions(self) -> int:
        """As asked for, else sized by the text."""
        if self._partitions is not None:
            return self._partitions
        return partitions_for(self._volume[0], int(self.files.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    @cached_property
    def counts(self) -> DataFrame:
        """Twelve rows per module-version; also kept."""
        return settle(unique_counts(self.occurrences))

    @cached_property
    def loc(self) -> DataFrame:
        return loc(self.facts)

    def overview(self) -> DataFrame:
        return report.overview(self.modules, self.loc, self.counts)

    def density(self) -> DataFrame:
        return report.density(self.overview())

    def summary(self) -> DataFrame:
        return report.summary(self.counts, self.loc if self.modules is None else self.modules)

    def details(self) -> DataFrame:
        return report.module_details(self.modules, self.loc, self.counts, self.occurrences)

    def detail_lines(self) -> DataFrame:
        return report.detail_lines(self.occurrences)

    def json(self) -> DataFrame:
        return report.occurrence_json(self.occurrences)

    def version_delta(self, order: DataFrame) -> DataFrame:
        return version_delta(self.overview(), order)
