"""The build over a directory: documents once, then independent derivations and their sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.errors import ErrorLog, InputError, ValidationError
from corpusmill.operators import bundles, chunks, documents, graph, links, manifest, metadata, navigation, patterns, quality, symbols, tags
from corpusmill.perf import Metrics
from corpusmill.plans import server, sinks
from corpusmill.session import cut
from corpusmill.sources import files
from corpusmill.sources.config import Options
from corpusmill.streaming import incremental


def load_documents(spark: SparkSession, options: Options, found: tuple[str, DataFrame]) -> tuple[DataFrame, dict]:
    """Documents of the files ``found``, written once to the shared folder, and the site's metadata."""
    given = {"include": options.include, "exclude": options.exclude, "tokens": [*files.EXCLUDED, *options.exclude_tokens], "found": found}
    name = os.path.basename(os.path.abspath(options.input.removeprefix("file:")))
    top = files.scan(spark, options.input, keep=lambda p: p.isin(*metadata.ROOT_INDEX), **given)
    site = metadata.site_metadata(top, name).first().asDict()
    docs = cut(files.read_documents(spark, options.input, **given))
    if options.patterns:
        chosen = patterns.PatternSet(options.patterns)
        docs = docs.where(~F.coalesce(chosen.option(F.col("path"), "exclude"), F.lit(False)))
    return docs, site


def chunked(docs: DataFrame, options: Options) -> DataFrame:
    """Chunks by the profile of each document's patterns, else of the options."""
    if not options.patterns:
        return chunks.chunks(docs, options.chunk_profile)
    chosen = patterns.PatternSet(options.patterns)
    named = docs.withColumn("profile_", F.coalesce(chosen.option(F.col("path"), "chunkProfile"), F.lit(options.chunk_profile)))
    used = {o["chunkProfile"] for o in chosen.patterns.values() if "chunkProfile" in o} | {options.chunk_profile}
    parts = [chunks.chunks(named.where(F.col("profile_") == p), p) for p in sorted(used & set(chunks.PROFILES))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def single_files(spark: SparkSession, out: str, written: list[str]) -> None:
    """The tables that a build wrote as folders, as one file each; for corpora that one reader can take."""
    read = lambda name: spark.read.json(f"{out}/{name}")
    if "chunks" in written:
        sinks.write_lines(spark.read.text(f"{out}/chunks"), f"{out}/chunks.jsonl", "value")
    whole = {
        "manifest": ("manifest.json", {"documents": ("manifest", ["path"])}), "tags": ("tags.json", {"documents": ("tags/by-document", ["path"])}),
        "graph": ("graph.json", {"nodes": ("graph/nodes", ["path"]), "edges": ("graph/edges", ["source", "target", "pos"])}),
        "graph_sections": ("graph-sections.json", {"nodes": ("graph/section-nodes", ["id"]), "edges": ("graph/section-edges", ["source", "target"])}),
        "bundles": ("bundles.meta.json", {"bundles": ("bundles.meta", ["size"])}), "symbols": ("ast-index.json", {"symbols": ("symbols", ["file", "line"])}),
        "index": ("master-index.json", {"directories": ("index/directories", ["path"])}),
    }
    for step, (file, parts) in whole.items():
        if step in written:
            sinks.write_document({name: (read(folder), order) for name, (folder, order) in parts.items()}, f"{out}/{file}")
    if "tags" in written:
        sinks.write_document({"tags": (read("tags/by-tag"), ["tag"])}, f"{out}/tags-by-tag.json")
    if "index" in written:
        # a directory's own entries; limits of its size are those of ``security.crowded_directories``
        sinks.write_listed(navigation.index_lines(read("index/entries")), out)


def build(spark: SparkSession, options: Options, log: ErrorLog | None = None, metrics: Metrics | None = None) -> dict:
    """Run a build; returns what was written and how long it took."""
    log, metrics, out = log or ErrorLog(options.continue_on_error), metrics or Metrics(), options.output.rstrip("/")
    written: list[str] = []
    state = incremental.state_path(options.cache_dir or f"{out}/.cache", options.input) if options.incremental else None
    with metrics.timed("scan"):
        found_files = files.listed(spark, options.input)
        docs, site = load_documents(spark, options, found_files)
        total = docs.count()
    if not total:
        raise InputError(f"no documents in {options.input}")
    now = None
    if state:
        now = incremental.snapshot(docs.select("path", "content", "mtime", F.col("raw_size").alias("size")))
        changed = incremental.changes(incremental.load_state(spark, state), now).where("change <> 'unchanged'").count()
        metrics.record("changed", changed)
        if not changed:
            return {"documents": total, "written": [], "unchanged": True, "performance": metrics.report()}

    def step(name: str, action) -> None:
        try:
            with metrics.timed(name):
                action()
            written.append(name)
        except Exception as error:  # noqa: BLE001 - the log raises it again unless the run goes on
            log.handle(error)

    ordered = documents.ordered(docs, options.optional)
    step("llms", lambda: sinks.write_llms(ordered, site, out, options.base_url))
    edges = cut(links.edges(docs)) if options.graph or options.manifest else None
    nodes = cut(graph.nodes(docs, edges, options.damping, options.rounds)) if options.graph else None
    tagged = cut(tags.tags(docs, content_keywords=options.content_keywords)) if options.tags else None
    parts = cut(chunked(docs, options)) if options.chunks else None
    if nodes is not None:
        shown = edges if options.graph_external else edges.where("type <> 'external'")
        step("graph", lambda: (sinks.write_jsonl(nodes.orderBy(F.desc("importance"), "path"), f"{out}/graph/nodes"), sinks.write_jsonl(shown, f"{out}/graph/edges"), sinks.write_row_json(graph.analysis(nodes), f"{out}/graph/analysis.json")))
        if options.graph_sections:
            step("graph_sections", lambda: (sinks.write_jsonl(graph.section_nodes(docs), f"{out}/graph/section-nodes"), sinks.write_jsonl(graph.section_edges(docs, edges), f"{out}/graph/section-edges")))
    if tagged is not None:
        step("tags", lambda: (sinks.write_jsonl(tagged, f"{out}/tags/by-document"), sinks.write_jsonl(tags.inverted(tagged), f"{out}/tags/by-tag")))
    if parts is not None:
        step("chunks", lambda: (sinks.write_jsonl(parts, f"{out}/chunks"), sinks.write_row_json(chunks.statistics(parts), f"{out}/chunks.meta.json")))
    if options.manifest:
        entries = manifest.documents(docs, edges, tagged, parts)
        about = {"provenance": manifest.provenance(options.origin, options.repo_ref), "site": site}
        step("manifest", lambda: (sinks.write_jsonl(entries, f"{out}/manifest"), sinks.write_row_json(manifest.statistics(docs, parts), f"{out}/manifest.statistics.json"), sinks.write_json(about, f"{out}/manifest.site.json")))
    if options.bundles:

        def write_bundles() -> None:
            head = bundles.header(site["title"], site["description"], site["instructions"])
            found = cut(bundles.bundles(bundles.scores(docs, nodes), options.bundle_sizes, -(-len(head) // 4), options.base_url or ""))
            for row in bundles.rendered(found, docs, head, total, options.base_url or "").toLocalIterator():
                label = f"{row['size'] // 1000}k" if row["size"] >= 1000 else str(row["size"])
                sinks.write_text([row["text"]], f"{out}/llms-ctx-{label}.txt")
            sinks.write_jsonl(bundles.summary(found, docs.agg(F.count("*").alias("total"))), f"{out}/bundles.meta")

        step("bundles", write_bundles)
    if options.sitemap and options.base_url:
        step("sitemap", lambda: sinks.write_lines(navigation.sitemap_lines(navigation.sitemap(docs, options.base_url, options.sitemap_strip_extensions)), f"{out}/sitemap.xml"))
    elif options.sitemap:
        log.warn("a sitemap needs a base URL")
    if options.index:
        listed = found_files[1]
        rollup = navigation.directory_rollup(listed)
        step("index", lambda: (sinks.write_jsonl(navigation.entries(listed), f"{out}/index/entries"), sinks.write_jsonl(rollup, f"{out}/index/directories"), sinks.write_row_json(navigation.master_totals(rollup), f"{out}/master-index.json")))
    if options.toc:

        def write_toc() -> None:
            sinks.write_listed(navigation.toc_lines(docs), out, "")
            sinks.write_rows(navigation.toc(docs).orderBy("path"), f"{out}/toc-full.md", "line", "\n")

        step("toc", write_toc)
    if options.ast:
        code = files.code_files(spark, options.input, found=found_files)
        found = cut(symbols.symbols(code))
        step("symbols", lambda: (sinks.write_jsonl(found, f"{out}/symbols"), sinks.write_rows(sinks.symbols_text(found), f"{out}/symbols.txt", end="\n"), sinks.write_jsonl(symbols.totals(code, found), f"{out}/symbols.totals")))
    if options.single_files:
        step("single_files", lambda: single_files(spark, out, written))
    if options.mcp:
        step("mcp", lambda: server.write_configs(out, "corpusmill", "python", "-m", "corpusmill", options.input))
    valid = None
    if options.validate or options.validate_ai:
        lines = spark.read.text(f"{out}/llms.txt", wholetext=True).select(F.lit("llms.txt").alias("path"), F.col("value").alias("content"))
        found = quality.structure(lines, bool(options.base_url))
        sinks.write_jsonl(found, f"{out}/report/structure")
        broken = spark.read.text(f"{out}/report/structure").count()
        if broken:
            log.handle(ValidationError(f"llms.txt: {broken} issues, see report/structure"))
    if options.validate_ai:
        found = cut(quality.issues(docs, parts))
        valid = quality.report(found).first().asDict()
        step("report", lambda: (sinks.write_jsonl(found, f"{out}/report/issues"), sinks.write_json(valid | {"recommendations": [r.asDict() for r in quality.recommendations(found).collect()]}, f"{out}/report.json")))
    if state:
        incremental.commit_state(now, state)
    return {"documents": total, "written": written, "report": valid, "errors": log.summary(), "performance": metrics.report()}
