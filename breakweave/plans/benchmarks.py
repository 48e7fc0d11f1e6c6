"""Result tables of benchmark runs: caller summaries, threshold sweeps, several chromosomes, and command lines.

The matcher that makes the summaries is an external program; here are its command line, its summary reader, and a
plain matcher of its own name for runs without it.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import matching
from ..operators.bandjoin import interval_join
from ..operators.metrics import with_prf
from ..sources.tables import write_text
from ..sources.variants import SUMMARY_COUNTS, SUMMARY_FLOATS, read_summary

#: Roles of chromosomes in the published comparison: fixed values.
ROLES = {"19": "validation", "20": "training", "22": "training", "21": "primary held-out test"}
OTHER_ROLE = "additional held-out test"
#: Matching parameters.
REFDIST, PCTSIZE, SIZEMIN, PCTSEQ = 500, 0.5, 50, 0.0


def six(value: float) -> str:
    return f"{value:.6f}"


def role_of(chrom: str) -> str:
    return ROLES.get(bare(chrom), OTHER_ROLE)


def bare(chrom: str) -> str:
    return chrom[3:] if chrom.lower().startswith("chr") else chrom


def parse_chromosomes(text: str) -> list[str]:
    """Comma-separated names without 'chr'; ValueError if there are none."""
    out = [bare(c.strip()) for c in text.split(",") if c.strip()]
    if not out:
        raise ValueError("no chromosome given")
    return out


def parse_tools(text: str, known: dict[str, str]) -> list[str]:
    """Comma-separated tools by name or alias; ValueError for unknown ones or none."""
    out = []
    for t in (x.strip().lower() for x in text.split(",") if x.strip()):
        if t not in known:
            raise ValueError(f"unknown tool: {t}")
        out.append(known[t])
    if not out:
        raise ValueError("no tool given")
    return list(dict.fromkeys(out))


def parse_thresholds(text: str) -> list[float]:
    """Comma-separated numbers; ValueError if there are none."""
    out = [float(x) for x in text.split(",") if x.strip()]
    if not out:
        raise ValueError("no threshold given")
    return out


def render(template: str, chrom: str) -> str:
    """A path template with {chrom}."""
    return template.format(chrom=bare(chrom))


def matcher_command(base_vcf: str, call_vcf: str, outdir: str, bed: str | None = None, refdist: int = REFDIST, pctsize: float = PCTSIZE, sizemin: int = SIZEMIN, pctseq: float = PCTSEQ) -> list[str]:
    """Command line of the external matcher."""
    more = ["--includebed", bed] if bed else []
    return ["truvari", "bench", "-b", base_vcf, "-c", call_vcf, "-o", outdir, *more, "--passonly", "--refdist", str(refdist), "--pctsize", str(pctsize), "--sizemin", str(sizemin), "--pctseq", str(pctseq)]


def in_regions(rows: DataFrame, regions: DataFrame, start: str, end: Column) -> DataFrame:
    """Rows whose whole span lies in one of the regions (chrom, start, end; half open); each row once."""
    spans = regions.select("chrom", F.col("start").alias("_r_start"), (F.col("end") - 1).alias("_r_last"), F.col("end").alias("_r_end"))
    keyed = rows.withColumns({"_row": F.struct(*rows.columns), "_s": F.col(start), "_e": end})
    inside = interval_join(spans, keyed, ["chrom"], "_r_start", "_r_last", "_s").where(F.col("_e") <= F.col("_r_end"))
    return inside.select("chrom", "_row").groupBy("_row").agg(F.first("chrom").alias("_c")).select("_row.*")


def one_to_one(calls: DataFrame, truth: DataFrame, refdist: int = REFDIST, pctsize: float = PCTSIZE) -> DataFrame:
    """(call_id, truth_ordinal): greedy one-to-one matches, nearest first, then the more similar, then by id."""
    c = calls.select("call_id", "chrom", "svtype", F.col("start").alias("pos"), F.col("median_svlen").alias("size"))
    return matching.one_to_one(c, truth.select("truth_ordinal", "chrom", "svtype", "pos", F.col("svlen").alias("size")), refdist, pctsize)


def native_match(calls: DataFrame, truth: DataFrame, refdist: int = REFDIST, pctsize: float = PCTSIZE, regions: DataFrame | None = None) -> DataFrame:
    """Counts of a plain one-to-one matcher, within ``regions`` where they are given.

    Not the external matcher; use it for trends only. ``calls`` has call_id, chrom, svtype, start and median_svlen.
    """
    if regions is not None:
        span = lambda start, size: F.col(start) + F.when(F.col("svtype") == "DEL", F.abs(size)).otherwise(1)
        calls, truth = in_regions(calls, regions, "start", span("start", "median_svlen")), in_regions(truth, regions, "pos", span("pos", "svlen"))
    zero = F.lit(0).cast("bigint")
    found = one_to_one(calls, truth, refdist, pctsize).agg(F.count(F.lit(1)).alias("tp")).select("tp", F.col("tp").alias("tp_base"), zero.alias("calls"), zero.alias("truths"))
    found = found.unionByName(calls.agg(F.count(F.lit(1)).alias("calls")).select(zero.alias("tp"), zero.alias("tp_base"), "calls", zero.alias("truths")))
    found = found.unionByName(truth.agg(F.count(F.lit(1)).alias("truths")).select(zero.alias("tp"), zero.alias("tp_base"), zero.alias("calls"), "truths"))
    out = found.agg(*[F.sum(c).alias(c) for c in ("tp", "tp_base", "calls", "truths")])
    out = out.select("tp", "tp_base", (F.col("calls") - F.col("tp")).alias("fp"), (F.col("truths") - F.col("tp_base")).alias("fn"))
    return with_prf(out)


@dataclass(frozen=True)
class Source:
    name: str
    path: str


def summary_rows(sources: list[Source | None], required: bool = False) -> list[dict]:
    """One row per summary; an absent argument is skipped unless required, a missing file raises, no row at all too."""
    rows = []
    for s in sources:
        if s is None or not s.path:
            if required:
                raise ValueError("a summary path is missing")
            continue
        if not Path(s.path).exists():
            raise FileNotFoundError(f"Missing summary for {s.name}: {s.path}")
        rows.append({"name": s.name} | read_summary(s.path) | {"summary": s.path})
    if not rows:
        raise ValueError("no summary given")
    return rows


def summary_tsv(rows: list[dict], first: str = "Method") -> str:
    head = [first, "Precision", "Recall", "F1", *SUMMARY_COUNTS, "Summary"]
    lines = ["\t".join([r["name"], *[six(r[m]) for m in SUMMARY_FLOATS], *[str(r[m]) for m in SUMMARY_COUNTS], r["summary"]]) for r in rows]
    return "\n".join(["\t".join(head), *lines]) + "\n"


def markdown_table(rows: list[dict]) -> str:
    head = ["Method", "Precision", "Recall", "F1", *SUMMARY_COUNTS]
    out = ["| " + " | ".join(head) + " |", "| " + " | ".join("---" for _ in head) + " |"]
    out += ["| " + " | ".join([r["name"], *[six(r[m]) for m in SUMMARY_FLOATS], *[str(r[m]) for m in SUMMARY_COUNTS]]) + " |" for r in rows]
    return "\n".join(out) + "\n"


def write_results(rows: list[dict], outdir: str, name: str, notes: str = "") -> dict[str, str]:
    """A TSV and a README of their own names."""
    files = {"tsv": f"{outdir}/{name}.tsv", "readme": f"{outdir}/README_{name}.md"}
    write_text(files["tsv"], summary_tsv(rows))
    write_text(files["readme"], f"# {name}\n\n{markdown_table(rows)}\n{notes}")
    return files


def best_row(rows: list[dict]) -> dict:
    """The first row with the largest (f1, recall, precision)."""
    return max(enumerate(rows), key=lambda r: (r[1]["f1"], r[1]["recall"], r[1]["precision"], -r[0]))[1]


def sweep_tsv(rows: list[dict]) -> str:
    """Rows with threshold and summary metrics."""
    head = ["threshold", "precision", "recall", "f1", *SUMMARY_COUNTS]
    return "\n".join(["\t".join(head), *["\t".join([f"{r['threshold']:.2f}", *[six(r[m]) for m in SUMMARY_FLOATS], *[str(r[m]) for m in SUMMARY_COUNTS]]) for r in rows]]) + "\n"


_SUMMARY = "precision double, recall double, f1 double, `TP-comp` bigint, `TP-base` bigint, FP bigint, FN bigint, `base cnt` bigint, `comp cnt` bigint"


def comparison(summaries: DataFrame) -> DataFrame:
    """The comparison table of rows (chrom, tool, path, value, place), value being a summary's JSON text; absent metrics are 0."""
    clean = F.regexp_replace("chrom", "(?i)^chr", "")
    role = F.lit(OTHER_ROLE)
    for chrom, name in ROLES.items():
        role = F.when(clean == chrom, name).otherwise(role)
    rows = summaries.select("*", clean.alias("_clean"), role.alias("Role"), F.from_json("value", _SUMMARY).alias("m"))
    number = lambda c, zero: F.coalesce(F.col(f"m.`{c}`"), F.lit(zero))
    return rows.orderBy("place").select(
        F.concat(F.lit("chr"), "_clean").alias("Chromosome"), "Role", F.col("tool").alias("Tool"), *[X.sixes(number(m, 0.0)).alias(n) for m, n in (("precision", "Precision"), ("recall", "Recall"), ("f1", "F1"))],
        *[number(c, 0).cast("bigint").alias(c) for c in SUMMARY_COUNTS], number("base cnt", 0).cast("bigint").alias("BaseCount"), number("comp cnt", 0).cast("bigint").alias("CompCount"), F.col("path").alias("Summary"),
    )


def collect_chromosomes(spark: SparkSession, found: list[tuple[str, str, str]]) -> DataFrame:
    """(chromosome, tool, summary path) triples as the comparison table over several chromosomes; a missing file raises."""
    for chrom, tool, path in found:
        if not Path(path).exists():
            raise FileNotFoundError(f"Missing {tool} chr{bare(chrom)} benchmark summary: {path}")
    # a summary is a dozen numbers, and there are as many as were named
    return comparison(spark.createDataFrame([(c, t, p, Path(p).read_text(), i) for i, (c, t, p) in enumerate(found)], "chrom string, tool string, path string, value string, place int"))


# --- command lines of foreign callers, and running them


def caller_command(tool: str, bam: str, reference: str, outdir: str, threads: int = 16, sizemin: int = SIZEMIN) -> list[str]:
    """Command line of a foreign caller: sniffles, cutesv or svim."""
    if tool == "sniffles":
        return ["sniffles", "--input", bam, "--vcf", f"{outdir}/sniffles.vcf", "--reference", reference, "--threads", str(threads), "--minsvlen", str(sizemin)]
    if tool == "cutesv":
        return ["cuteSV", bam, reference, f"{outdir}/cutesv.vcf", f"{outdir}/work", "--threads", str(threads), "--min_size", str(sizemin), "--genotype"]
    if tool == "svim":
        return ["svim", "alignment", outdir, bam, reference, "--min_sv_size", str(sizemin)]
    raise ValueError(f"unknown tool: {tool}")


#: The file in its output folder that a caller writes.
CALLER_VCF = {"sniffles": "sniffles.vcf", "cutesv": "cutesv.vcf", "svim": "variants.vcf"}


def plan_runs(chroms: list[str], tools: list[str], templates: dict[str, str], reference: str, threads: int = 16, skip_existing: bool = False, **matcher) -> list[list[str]]:
    """Command lines of all callers on all chromosomes, each with its matcher run after it.

    ``templates`` are paths with {chrom}: bam, truth, bed, out. A caller whose VCF is there already is left out with
    ``skip_existing``; its matcher runs all the same.
    """
    commands = []
    for chrom in chroms:
        at = {k: render(v, chrom) for k, v in templates.items()}
        for tool in tools:
            outdir = f"{at['out']}/{tool}"
            vcf = f"{outdir}/{CALLER_VCF[tool]}"
            if not (skip_existing and Path(vcf).exists()):
                commands.append(caller_command(tool, at["bam"], reference, outdir, threads, matcher.get("sizemin", SIZEMIN)))
            commands.append(matcher_command(at["truth"], vcf, f"{outdir}/bench", at.get("bed"), **matcher))
    return commands


def run_all(commands: list[list[str]], dry_run: bool = False, run: Callable[[list[str]], object] | None = None) -> list[str]:
    """Runs command lines one after the other, the first failure raises; a dry run only tells them. Output folders are made."""
    for command in [] if dry_run else commands:
        for part in (c for c in command if c.endswith((".vcf", "/work"))):
            Path(part).parent.mkdir(parents=True, exist_ok=True)
        (run or (lambda c: subprocess.run(c, check=True)))(command)
    return [" ".join(c) for c in commands]
