"""The stages from pages to messages, around a model backend."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.fixed_values import REFINE_CATEGORY, STAGE_COLUMNS
from pagemill.functions.messages import stage_prompt
from pagemill.functions.text import SECTION_METHODS, clean_completion, cut_sections
from pagemill.operators.completions import Backend, failures, generate, pending_rows, succeeded
from pagemill.operators.numbering import position_cutoffs
from pagemill.operators.routing import route_categories
from pagemill.plans.mix import build_mix
from pagemill.sources.records import PAGES, read_json_in_order
from pagemill.sources.stages import StageStore


def stage_projection(df: DataFrame, stage: str, keys: Sequence[str] = ("seq",)) -> DataFrame:
    return df.select(*keys, *STAGE_COLUMNS[stage])


# Columns of the stage tables that are not results.
RESERVED = ("wave", "attempts", "prompt_hash", "completion", "_prompt", "_answer")


def plain(prompt: Column) -> Column:
    return prompt


@dataclass
class Synthesis:
    """One run over ``pages (seq, webpage, ...)``, with a table per stage.

    A stage calls the model once per row and writes its table before the next
    one reads it. Rows whose call failed stay in the table with a null answer;
    they go no further and ``failed`` lists them. Other columns of the pages are
    passed through, unless ``project`` is set; pages with a column of a name in
    ``RESERVED`` are refused.

    A store belongs to one run: it keeps the number and a checksum of the pages with all columns, the
    paths of ``ingest`` and all settings that decide results, and a run in which
    one of them differs is refused.

    Inside a wave, the answers of each call of the model are logged beside its table until the
    wave is written, so neither a lost task nor a lost job sends what was answered again.

    A stage may be written in several ``waves`` of consecutive rows. A run that
    is started again on the same store calls the model only for the waves that
    are not finished, and for rows that have no answer yet: those that failed, and
    those that an earlier stage has answered since. Rows keep the category they
    were first asked with.

    ``envelope`` wraps a prompt into what the backend expects, for example
    ``lambda p: chat_text(p, model)`` or ``lambda p: F.to_json(api_messages(p))``.
    """

    store: StageStore
    backend: Backend
    clean: bool = True
    section_method: str = "uniform"
    seed: str = ""
    project: bool = False
    waves: int = 1
    envelope: Callable[[Column], Column] = plain
    generate_options: dict[str, Any] = field(default_factory=dict)
    _asked: set[str] = field(default_factory=set, init=False, repr=False)

    def __post_init__(self) -> None:
        if self.section_method not in SECTION_METHODS:
            raise ValueError(f"section method {self.section_method!r} is not one of {SECTION_METHODS}")

    def ingest(self, paths: Sequence[str], schema=PAGES, lines: bool = False, split: bool = False) -> DataFrame:
        """Read page files in order into a table. ``seq`` is fixed by writing it:
        read ids depend on how the files were split. ``split`` is for large array files."""
        self.store.same_run("ingest", {"paths": list(paths), "lines": lines})
        read = read_json_in_order(self.store.spark, paths, schema, lines, split)
        self.store.ensure("pages", lambda: read.withColumn("seq", F.monotonically_increasing_id()))
        return self.store.read("pages").drop("wave")

    def _identify(self, pages: DataFrame) -> None:
        """Refuse pages or settings other than those that the store was filled with."""
        if clash := sorted(set(RESERVED) & set(pages.columns)):
            raise ValueError(f"pages have reserved columns: {', '.join(clash)}")
        checksum = F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(pages.columns)]))
        count, checksum = pages.agg(F.count("*"), checksum).first()
        self.store.same_run(
            "run",
            {
                "pages": (count, checksum),
                "seed": self.seed,
                "section_method": self.section_method,
                "clean": self.clean,
                "project": self.project,
                "envelope": str(self.envelope(F.col("prompt"))),
                "options": sorted(dict(self.generate_options.get("options") or {}).items()),
            },
        )

    def _run(self, stage: str, rows: DataFrame, prompt: Column, answer: str) -> DataFrame:
        """The answered rows of a stage, after calling the model where needed."""
        cleaner = clean_completion if self.clean and answer != "author" else plain

        def answered(part: DataFrame, wave: int) -> DataFrame:
            log = self.store.answers(stage, wave)
            replies = generate(part, self.envelope(prompt), self.backend, log=log, **self.generate_options)
            return replies.withColumn(answer, cleaner(F.col("completion"))).drop("completion")

        ranges = self._wave_ranges(stage, rows)
        waves = len(ranges)
        resumed = all(self.store.finished(stage, wave) for wave in range(waves))
        for wave, low, high in ranges:
            within = F.lit(True) if low is None else F.col("seq") >= low
            if high is not None:
                within = within & (F.col("seq") < high)
            self.store.ensure(stage, lambda within=within, wave=wave: answered(rows.filter(within), wave), wave)
            self.store.answers(stage, wave).clear(self.store.spark)
        if resumed and stage not in self._asked:
            while self.store.finished(stage, waves):
                waves += 1
            open_rows = pending_rows(rows, succeeded(self.store.read(stage), answer), ["seq"])
            if open_rows.limit(1).count():
                self.store.write(stage, answered(open_rows, waves), waves)
                self.store.answers(stage, waves).clear(self.store.spark)
        self._asked.add(stage)
        done = succeeded(self.store.read(stage), answer).drop("wave", "attempts", "prompt_hash")
        if not self.project:
            return done
        keys = [c for c in ("seq", "category") if c in done.columns]
        return stage_projection(done, "response" if stage == "refine" else stage, keys)

    def _wave_ranges(self, stage: str, rows: DataFrame) -> list[tuple[int, int | None, int | None]]:
        """Number, first ``seq`` and end of each wave. Written before the first
        wave, so that a later run goes on with the same ones, whatever its
        ``waves``."""

        def planned() -> DataFrame:
            cutoffs = []
            if self.waves > 1:
                cutoffs = position_cutoffs(
                    rows.select("seq"), "seq", lambda n: [n * w // self.waves for w in range(1, self.waves)]
                )
            bounds = [None, *sorted({c for c in cutoffs if c is not None}), None]
            ranges = [(wave, *pair) for wave, pair in enumerate(zip(bounds, bounds[1:]))]
            return self.store.spark.createDataFrame(ranges, "number int, low bigint, high bigint")

        self.store.ensure(f"{stage}_waves", planned)
        return [tuple(r) for r in self.store.read(f"{stage}_waves").drop("wave").orderBy("number").collect()]

    def failed(self, stage: str) -> DataFrame:
        """The last attempt of each row of a stage that has no answer."""
        table, answer = self.store.read(stage), "response" if stage == "refine" else stage
        keys = [c for c in ("seq", "category") if c in table.columns]
        lasting = pending_rows(table, succeeded(table, answer), ["seq"])
        last = lasting.groupBy(F.col("seq").alias("_seq")).agg(F.max("wave").alias("_wave"))
        lasting = lasting.join(last, (F.col("seq") == F.col("_seq")) & (F.col("wave") == F.col("_wave")))
        return failures(lasting, keys, answer)

    def author(self, pages: DataFrame) -> DataFrame:
        """Authors are inferred from the full page; later stages see the cut one."""
        self._identify(pages)
        answered = self._run("author", pages, stage_prompt("author", web=F.col("webpage")), "author")
        return cut_sections(answered, method=self.section_method, seed=self.seed)

    def request(self, sections: DataFrame) -> DataFrame:
        prompt = stage_prompt(
            "request",
            category=F.col("category"),
            web=F.col("webpage"),
            author=F.col("author"),
            key=F.col("seq"),
            seed=self.seed,
        )
        return self._run("request", route_categories(sections), prompt, "request")

    def response(self, requests: DataFrame) -> DataFrame:
        prompt = stage_prompt(
            "response", category=F.col("category"), web=F.col("webpage"), request=F.col("request")
        )
        return self._run("response", requests, prompt, "response")

    def refine(self, responses: DataFrame) -> DataFrame:
        """Improve the answers of the WR categories, which keep their names."""
        prompt = stage_prompt(
            "response",
            category=F.lit(REFINE_CATEGORY),
            web=F.col("webpage"),
            request=F.col("request"),
            response=F.col("response"),
        )
        wr = responses.filter(F.col("category").isin("WR_all", "WR_part"))
        return self._run("refine", wr, prompt, "response")

    def pairs(self, pages: DataFrame) -> DataFrame:
        """``pool, seq, webpage, request, response``: WI rows from the response
        stage and WR rows from the refine stage. Slices follow ``seq``, so its
        order is also that of the appended category files."""
        responses = self.response(self.request(self.author(pages)))
        refined = self.refine(responses)
        columns = ["seq", "webpage", "request", "response"]
        wi = responses.filter(F.col("category").isin("WI_all", "WI_part"))
        return wi.select(F.lit("WI").alias("pool"), *columns).unionByName(
            refined.select(F.lit("WR").alias("pool"), *columns)
        )

    def messages(self, pages: DataFrame, **mix_options: Any) -> DataFrame:
        return build_mix(self.pairs(pages), seed=self.seed, **mix_options)
