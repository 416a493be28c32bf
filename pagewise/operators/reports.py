"""Reports as Markdown, of small aggregates that are collected for them, and the statistics that they show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import annotations as an
from ..functions import geometry as g
from ..functions.text import vocalisation
from . import stats

#: Statistics by name: of a page, or of each of its regions; what it is, and how many of the most frequent are kept.
DIMENSIONS: dict[str, tuple[str, int | None]] = {
    "templates": ("provenance.template", None), "degradation_presets": ("provenance.preset", None), "directions": ("page.direction", None), "backgrounds": ("provenance.background", None),
    "top_fonts": ("provenance.font", 10),
}
TITLES = {"templates": "Templates", "degradation_presets": "Capture conditions", "directions": "Reading direction", "region_types": "Region types", "vocalisation": "Vocalisation"}


def page_counts(records: DataFrame) -> DataFrame:
    """``dimension``, ``value``, ``n``, ``first`` of rows of id, page and provenance; a value that is null counts nowhere."""
    page, known = F.col("page"), set(records.select("provenance.*").columns) if "provenance" in records.columns else set()
    pair = lambda name, value: F.struct(F.lit(name).alias("dimension"), value.cast("string").alias("value"))
    one = [pair(k, F.col(path)) for k, (path, _) in DIMENSIONS.items() if not path.startswith("provenance.") or path.split(".")[1] in known]
    one += [pair("top_page_sizes", F.concat_ws("x", page["width"], page["height"])), pair("vocalisation", vocalisation(an.page_text(page)))]
    kinds = F.transform(page["regions"], lambda r: pair("region_types", r["type"]))
    pairs = records.select("id", F.explode(F.concat(F.array(*one), kinds)).alias("p")).select("id", "p.*").where("value is not null and value <> ''")
    return pairs.groupBy("dimension", "value").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def corpus_totals(records: DataFrame) -> DataFrame:
    """One row: pages, documents, lines, words and characters of page records."""
    lines = an.page_lines(F.col("page"))
    add = lambda value: F.aggregate(F.transform(F.col("lines"), value), F.lit(0), lambda a, x: a + x)
    index = F.col("provenance.index") if "index" in records.select("provenance.*").columns else F.col("id")
    each = records.select("id", index.alias("i"), lines.alias("lines"))
    counted = each.select("i", F.size("lines").alias("l"), add(lambda x: stats.line_words(x).cast("int")).alias("w"), add(lambda x: F.char_length(x["text"])).alias("c"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return counted.agg(F.count("*").alias("pages"), F.countDistinct("i").alias("documents"), zero("l").alias("lines"), zero("w").alias("words"), zero("c").alias("characters"))


def corpus_stats(records: DataFrame) -> dict:
    """All statistics of page records (id, page, provenance) as plain data; what is collected is one row a value that counts."""
    lines = records.select(F.explode(an.page_lines(F.col("page"))).alias("x")).select("x.text", g.height(F.col("x.bbox")).alias("h"))
    chars = stats.alphabet(lines)
    out = corpus_totals(records).first().asDict() | {"alphabet_size": chars.count()}
    heights = {r["fraction"]: r["value"] for r in stats.nearest_rank(lines.withColumn("h", F.round("h", 2)), "h").collect()}
    out["line_height_px"] = {name: round(heights[f], 2) for name, f in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95)) if f in heights}
    limits = {k: n for k, (_, n) in DIMENSIONS.items()} | {"top_page_sizes": 5, "vocalisation": None, "region_types": None}
    counts: dict[str, list] = {k: [] for k in limits}
    for r in page_counts(records).orderBy(F.desc("n"), "first", "value").toLocalIterator():
        if limits[r["dimension"]] is None or len(counts[r["dimension"]]) < limits[r["dimension"]]:
            counts[r["dimension"]].append((r["value"], r["n"]))
    out |= {k: dict(v) for k, v in counts.items()}
    return out | {"rarest_characters": [r["char"] for r in stats.rarest(chars).collect()][::-1]}


def _list(pairs: list[str]) -> str:
    return "\n".join(pairs) + "\n"


def stats_markdown(data: dict) -> str:
    """A part of a dataset's card."""
    out = ["## Dataset statistics", "", f"- **Pages**: {data['pages']:,} across {data['documents']:,} documents"]
    out += [f"- **{k.title()}**: {data[k]:,}" for k in ("lines", "words")]
    out.append(f"- **Characters**: {data['characters']:,} ({data['alphabet_size']} distinct)")
    if h := data["line_height_px"]:
        out.append(f"- **Line height (px)**: p5 {h['p5']}, median {h['p50']}, p95 {h['p95']}")
    for key, title in TITLES.items():
        if counts := data.get(key):
            out += ["", f"### {title}", "", *(f"- `{k}`: {n:,} ({n / sum(counts.values()):.1%})" for k, n in counts.items())]
    return _list(out)


def evaluation_markdown(report: dict, target: str = "text", marks_ignored: bool = False) -> str:
    """The scores of a model; ``report`` is the row of ``evaluation.report`` as a dictionary."""
    lost = f" ({report['missing']:,} missing)" if report["missing"] else ""
    rows = {
        "Samples scored": f"{report['samples']:,}{lost}", "Target": f"`{target}`" + " (diacritics ignored)" * marks_ignored,
        "CER": f"{report['cer_macro']:.4f} macro / {report['cer_micro']:.4f} micro", "WER": f"{report['wer']:.4f}", "Similarity": f"{report['similarity']:.4f}",
    }
    return _list(["## Evaluation", "", *(f"- **{k}**: {v}" for k, v in rows.items())])


#: What to turn where a feature of made pages is off.
REMEDIES = {
    "ink_fraction": "how densely pages are set: font sizes, margins, text of the templates", "ink_darkness": "the colours of ink", "paper_lightness": "the tints of the background",
    "contrast": "ink and background, or the contrast step", "stroke_width": "font weights, ink spread and ink erosion", "edge_density": "blur and downscale: crisp pages have more edges",
    "high_frequency_energy": "blur, downscale and noise", "block_noise": "the quality of compression", "illumination_range": "illumination, shadow and vignette", "aspect_ratio": "paper sizes and the share of landscape",
}


def mean_overlap(comparison: DataFrame) -> Column | float:
    """The mean overlap of the features of ``compare.compare``; 0 where there are none."""
    return float(comparison.agg(F.avg("overlap")).first()[0] or 0.0)


def comparison_markdown(rows: list, made_count: int, real_count: int) -> str:
    """Features side by side, largest differences first, and what to change; rows are those of ``compare.compare``."""
    rows = sorted(rows, key=lambda r: -abs(r["cohens_d"]))
    overlap = sum(r["overlap"] for r in rows) / len(rows) if rows else 0.0
    out = ["## Synthetic vs real", "", f"- **Images**: {made_count:,} synthetic, {real_count:,} real", f"- **Mean distribution overlap**: {overlap:.1%}", ""]
    out += ["| feature | synthetic | real | gap | overlap | verdict |", "| --- | ---: | ---: | ---: | ---: | --- |"]
    out += [f"| `{r['feature']}` | {r['made_mean']:.3g} | {r['real_mean']:.3g} | {r['relative']:+.0%} | {r['overlap']:.0%} | {r['verdict']} |" for r in rows]
    wrong = [r for r in rows if r["verdict"] == "mismatched"]
    if not wrong:
        return _list([*out, "", "No feature is mismatched at a large effect size."])
    told = (f"- **`{r['feature']}`** is {'too high' if r['cohens_d'] > 0 else 'too low'} ({r['relative']:+.0%}) - {REMEDIES.get(r['feature'], 'look at the configuration')}" for r in wrong)
    return _list([*out, "", "### What to change", "", *told])


def ablation_markdown(name: str, arms: list[dict]) -> str:
    """The arms of an ablation: ``name``, ``overrides`` and ``dir`` of each."""
    rows = (f"| `{a['name']}` | {', '.join(f'`{o}`' for o in a['overrides']) or '_(baseline)_'} | `{a['dir']}` |" for a in arms)
    return _list([f"## Ablation: {name}", "", "All arms have one seed and differ in what is named only; compare them on real pages.", "", "| arm | changes | corpus |", "| --- | --- | --- |", *rows])
