"""A run put together from settings: which steps it has, and what they are."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from formgrain.errors import ConfigurationError
from formgrain.operators import kernels, template
from formgrain.operators import repair as R
from formgrain.plans.runner import Flow
from formgrain.sources import models
from formgrain.sources.dataset import Settings, chosen, dataset_summary, decoded_photos, form_files, manifest, names_in
from formgrain.sources.store import ArtifactStore, describe_run, write_run_files


def client(url: str, settings: Settings) -> Callable[[dict], dict]:
    if not url:
        raise ConfigurationError("a served model needs its URL in the settings")
    return models.HttpClient(url, settings.server_token or settings.api_key, settings.timeout)


def flow_of(settings: Settings, store: ArtifactStore | None = None, reuse: bool = False, photos: DataFrame | None = None) -> Flow:
    """The steps that the settings name; a name that isn't known is an error before anything runs.

    ``photos``: decoded images (form_id and the columns of the image source), which a straightener needs.
    """
    rules = tuple(R.named(settings.repair_rules)) if settings.repair_rules != "all" else tuple(R.RULES)
    for name, registry in ((settings.straightener, models.STRAIGHTENERS), (settings.ocr_engine, models.OCR), (settings.structurer, models.STRUCTURERS)):
        if name and name not in registry:
            registry.build(name)  # raises, and says which names there are
    reads_text = settings.structurer == "text"
    prompt = settings.structuring_prompt or ("text" if reads_text else "image")

    def reader():
        return models.OCR.build(settings.ocr_engine) if settings.ocr_engine == "none" else models.OCR.build(settings.ocr_engine, client(settings.ocr_url, settings))

    def structurer():
        return models.STRUCTURERS.build(settings.structurer, client(settings.structure_url, settings), settings.model, prompt)

    def straighten(forms: DataFrame) -> DataFrame:
        flat = models.STRAIGHTENERS[settings.straightener](photos.join(forms.select("form_id"), "form_id", "left_semi"))
        return flat.select("form_id", "content", "suffix")

    paths = refined_paths(settings.refine_fields)
    if paths and not settings.straightener:
        raise ConfigurationError("fields are read again from flat pages: a straightener has to be set")
    return Flow(
        straighten=straighten if settings.straightener else None,
        structure=lambda forms: models.structure_pages(forms, structurer, settings.retries),
        ocr=(lambda forms: models.read_pages(forms, reader)) if reads_text else None,
        refine=(lambda forms: refine_pages(forms, settings)) if paths else None,
        refine_paths=paths,
        rules=rules,
        store=store,
        reuse=reuse,
        prices=(settings.input_price, settings.output_price),
    )


def refined_paths(listed: str) -> tuple[str, ...]:
    """Paths of the fields that are read again; a field without a place on the form can't be."""
    places = [path for kind, path, *_ in template.rows() if kind == "field"]
    names = names_in(listed)
    if unknown := [n for n in names if n not in {p.rpartition(".")[2] for p in places}]:
        raise ConfigurationError(f"{unknown[0]!r} can't be read again; known: {', '.join(sorted({p.rpartition('.')[2] for p in places}))}")
    return tuple(p for p in places if p.rpartition(".")[2] in names)


def refine_pages(pages: DataFrame, settings: Settings) -> DataFrame:
    """Flat pages (form_id, content as a PNG file) -> form_id, answers by path, whether the re-reading failed. One call for a form.

    Pages are brought to the size of the printed form; its places are then those of the fields.
    """
    names = list(names_in(settings.refine_fields))
    wanted = refined_paths(settings.refine_fields)
    boxes = {path: tuple(round(v * kernels.SCALE) for v in box) for kind, path, *box in template.rows() if kind == "field" and path in wanted}

    def ask(batches):
        reader = models.FieldReader(client(settings.structure_url, settings), names, settings.model)
        for rows in batches:
            answers = []
            for content in rows["content"]:
                try:
                    answers.append(reader.ask(kernels.crops(kernels.resized(kernels.from_png(bytes(content)), template.PAGE), boxes, settings.refine_scale)))
                except Exception:  # a page that can't be cut is one that wasn't read again
                    answers.append(None)
            yield pd.DataFrame({"form_id": rows["form_id"], "answers": pd.Series(answers, dtype=object), "refine_failed": [x is None for x in answers]})

    return pages.select("form_id", "content").mapInPandas(ask, "form_id string, answers map<string,string>, refine_failed boolean")


def run(spark: SparkSession, settings: Settings, run_id: str, dev: int | None = None, test: int | None = None, reuse: bool = False, command: str = "") -> dict:
    """The first forms of each split through the configured steps; writes the run's artifacts, ``run.json`` and ``summary.json``; returns the summary."""
    root = settings.dataset_dir
    forms = chosen(manifest(spark, root), settings.dev_count if dev is None else dev, settings.test_count if test is None else test)
    images, truth = form_files(spark, root, forms)
    store = ArtifactStore(spark, settings.runs_dir, run_id)
    photos = decoded_photos(spark, root, forms) if settings.straightener else None
    flow = flow_of(settings, store, reuse, photos)
    if settings.trace:
        spark.sparkContext.setJobGroup(run_id, f"run {run_id}")
    _, _, summary = flow.run(images.repartition(settings.workers, "form_id"), truth.select("form_id", "truth"))
    listed = [(r.id, r.split) for r in forms.orderBy("split_rank", "id").select("id", "split").collect()]  # the forms that were asked for
    fingerprint = dataset_summary(spark, root).first()
    write_run_files(spark, f"{settings.runs_dir}/{run_id}", describe_run(run_id, settings.public(), listed, command, fingerprint and fingerprint.fingerprint), summary)
    return summary
