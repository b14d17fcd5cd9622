"""The batch as a user runs it: files in, texts, manifest and dataset out."""

import json
import sys
import types

import pytest
from pyspark.sql import functions as F

from slipweave import cli
from slipweave.conf import Settings
from slipweave.operators import images, pixels, recognize
from slipweave.operators.ordinal import with_ordinal
from slipweave.plans import dataset, pipeline, shared
from slipweave.sources import files, sinks
from slipweave.streaming.watch import watch

LATTE = "Latte|10|100|120|122|0.9\n3.10|300|101|350|121|\n"


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.JPG").write_bytes(LATTE.encode())
    (folder / "b.png").write_bytes(b"\xff\xfe")
    (folder / "c.heic").write_bytes(b"\n")
    (folder / "d.txt").write_bytes(b"x")
    (folder / ".e.webp").write_bytes(b"")
    return tmp_path


def test_batch(spark, inbox):
    out = f"{inbox}/out"
    run = pipeline.process(spark, f"{inbox}/in", out)
    got = {r.output_id: r for r in run.results.collect()}
    assert set(got) == {"a", "b", "c", ".e"} and (run.found, run.skipped) == (4, 0)
    assert got["a"].text == "Latte  3.10" and got["a"].status == "low_confidence" and got["a"].num_lines == 2
    raw = json.loads(got["a"].raw)
    assert raw["text_lines"][1] == {"text": "3.10", "bbox": [300.0, 101.0, 350.0, 121.0], "confidence": 0.0}
    assert raw["source_image"] == f"{inbox}/in/deep/a.JPG" and raw["preprocessing"]["rotation_applied_degrees"] == 0
    assert got["b"].status == "error" and got["b"].error and got["b"].output_paths == {}
    assert got[".e"].status == "error" and got[".e"].error == "empty file"
    assert got["c"].status == "empty" and got["c"].text == "" and got["c"].output_paths["text"] == f"{out}/texts"
    again = pipeline.process(spark, f"{inbox}/in", out)
    assert sorted(r.output_id for r in again.results.collect()) == [".e", "b"] and (again.found, again.skipped) == (2, 2)
    manifest = files.manifest(spark, f"{out}/manifest.jsonl")
    lines = [(r.run, r.output_id) for r in manifest.orderBy("pos").collect()]
    assert lines[:2] == [(0, ".e"), (0, "b")] and sorted(lines[2:4]) == [(0, "a"), (0, "c")] and [x[0] for x in lines[4:]] == [1, 1]
    records = dataset.build(manifest, files.latest(files.stored(spark, out)).select("output_id", "text"))
    assert sinks.write_dataset(records, f"{inbox}/ds") == 2


def test_overwrite_replaces_and_the_last_of_a_stem_counts(spark, tmp_path):
    for folder, text in (("x", "first|0|0|50|20|0.9"), ("y", "second|0|0|60|20|0.9")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "r.png").write_text(text)
    out = f"{tmp_path}/out"
    assert sorted(r.text for r in pipeline.process(spark, f"{tmp_path}/in", out).results.collect()) == ["first", "second"]
    assert [(r.output_id, r.text) for r in files.latest(files.stored(spark, out)).collect()] == [("r", "second")]
    assert pipeline.process(spark, f"{tmp_path}/in", out).results is None
    (tmp_path / "in" / "y" / "r.png").write_text("third|0|0|50|20|0.9")
    pipeline.process(spark, f"{tmp_path}/in", out, overwrite=True)
    texts = files.latest(files.stored(spark, out)).select("output_id", "text")
    records = dataset.build(files.manifest(spark, f"{out}/manifest.jsonl"), texts)
    assert [r.input for r in records.collect()] == ["third"] * 4  # a record per manifest line, always the newest text
    with pytest.raises(ValueError, match="duplicate"):
        pipeline.process(spark, f"{tmp_path}/in", f"{tmp_path}/other", unique_ids=True)


def test_manifest_order_over_files(spark, tmp_path):
    """Older lines in a small file come before newer ones in a large file, whatever Spark reads first."""
    path = f"{tmp_path}/manifest.jsonl"
    for run, names in ((0, ["z"]), (1, [f"n{i}" for i in range(500)])):
        rows = [("f", n, "ok", 1, 0.5, 0.1, i, run) for i, n in enumerate(names)]
        frame = spark.createDataFrame(rows, "file string, output_id string, status string, num_lines int, avg_confidence double, duration_s double, place long, run long")
        sinks.append_manifest(frame.withColumn("error", F.lit(None).cast("string")).coalesce(1), path)
    got = [r.output_id for r in files.manifest(spark, path).orderBy("pos").collect()]
    assert got == ["z", *[f"n{i}" for i in range(500)]]
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "1.jsonl").write_text("\n".join(f'{{"output_id": "a{i}", "status": "ok"}}' for i in range(3)) + "\n")
    (plain / "2.jsonl").write_text("\n".join(f'{{"output_id": "b{i}"}}' for i in range(300)) + "\n")
    assert [r.output_id for r in files.manifest(spark, str(plain)).orderBy("pos").collect()] == [*[f"a{i}" for i in range(3)], *[f"b{i}" for i in range(300)]]
    (plain / "3.jsonl").write_text('{"output_id": \n')
    with pytest.raises(Exception):
        files.manifest(spark, str(plain)).collect()
    (plain / "3.jsonl").write_text('\n{"output_id": "x"}\n')
    with pytest.raises(Exception, match="blank manifest line"):
        files.manifest(spark, str(plain)).collect()


def test_one_image(spark, inbox):
    out = f"{inbox}/out"
    name = pipeline.new_output_id()
    assert len(name) == 32 and name != pipeline.new_output_id()
    done = pipeline.process_image(spark, f"{inbox}/in/deep/a.JPG", out, output_id=name, layout=pipeline.FOLDERS)
    assert (done["output_id"], done["status"], done["text"]) == (name, "low_confidence", "Latte  3.10")
    assert done["output_paths"] == {"raw_json": f"{out}/{name}/raw.json", "text": f"{out}/{name}/text.txt"}
    assert (inbox / "out" / name / "text.txt").read_text() == "Latte  3.10"
    assert json.loads((inbox / "out" / name / "raw.json").read_text())["text_lines"][0]["confidence"] == 0.9
    lost = pipeline.process_image(spark, f"{inbox}/none.png", out)
    assert (lost["output_id"], lost["status"], lost["num_lines"]) == ("none", "error", 0) and "none.png" in lost["error"]
    assert files.manifest(spark, f"{out}/manifest.jsonl").where("status = 'error'").count() == 1


class Counting:
    """A model that writes down each time it is made."""

    def __init__(self, log):
        with open(log, "a") as f:
            f.write("made\n")

    def recognize(self, images, recognition_batch, detector_batch, math_mode):
        if any(text == "boom" for text, _ in images):
            raise RuntimeError("the device is gone")
        return recognize.TextRecognizer().recognize(images)

    def peak_memory(self):
        return 3 << 30


def test_chunks_one_model_per_worker_and_failed_calls(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(24):
        (tmp_path / "in" / f"r{i:02}.png").write_text("boom" if i == 9 else f"w{i}|0|0|50|20|0.9")
    log = str(tmp_path / "log")
    found = files.images(spark, f"{tmp_path}/in")
    out = recognize.detect(found, lambda: Counting(log), max_images_per_call=4).coalesce(1).collect()
    assert sorted(r.ordinal for r in out if r.error) == [8, 9, 10, 11] and {r.error for r in out if r.error} == {"the device is gone"}
    assert all(r.peak_memory == 3 << 30 and r.chunk == r.ordinal // 4 for r in out if not r.error)
    assert open(log).read().count("made") <= 4  # worker processes, not chunks
    assert recognize.factory_key(lambda: 1) != recognize.factory_key(lambda: 2)


def test_turned_images_are_turned_back(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.png").write_text("turned|270\nMocha|0|0|50|20|0.8")
    for on, degrees, conf in ((True, 270, 0.8), (False, 0, 0.4)):
        run = pipeline.process(spark, f"{tmp_path}/in", f"{tmp_path}/{on}", settings=Settings(orientation_fallback=on))
        row = run.results.first()
        assert json.loads(row.raw)["preprocessing"]["rotation_applied_degrees"] == degrees and row.avg_confidence == conf


def test_command_line(spark, inbox, capsys, monkeypatch):
    monkeypatch.chdir(inbox)
    (inbox / ".env").write_text("SHOP_LOW_CONFIDENCE=0.4\nSHOP_ROW_GAP_MULT=1000\n")
    run = ["run", "--input", "in", "--output", f"{inbox}/out", "--env-prefix", "SHOP_", "--layout", "folders"]
    assert cli.main(run) == 1
    said = capsys.readouterr().out
    assert "2 of 4 done" in said and "empty file" in said and "b.png" in said
    assert (inbox / "out" / "a" / "text.txt").read_text() == "Latte 3.10"  # settings of the .env file
    assert files.latest(files.stored(spark, f"{inbox}/out")).count() == 2
    for name in ("b.png", ".e.webp"):
        (inbox / "in" / "deep" / name).unlink()
    assert cli.main(run) == 0 and "nothing to do: 2 done before" in capsys.readouterr().out
    assert cli.main([*run, "--overwrite", "--max-batch", "-1"]) == 0
    assert cli.main([*run, "--overwrite", "--max-batch", "1"]) == 0
    assert cli.main(["dataset", "--output", f"{inbox}/out", "--dest", f"{inbox}/data.jsonl", "--one-file"]) == 0
    written = [json.loads(x)["input"] for x in (inbox / "data.jsonl").read_text().splitlines()]
    assert written == ["Latte 3.10", "", "Latte 3.10", ""]
    assert cli.main(["dataset", "--output", f"{inbox}/out", "--dest", f"{inbox}/parts"]) == 0
    assert cli.main(["check"]) == 0 and "Coffee" in capsys.readouterr().out
    single = ["run", "--input", f"{inbox}/in/deep/d.txt", "--output", f"{inbox}/one", "--output-id", "mine"]
    (inbox / "in" / "deep" / "d.txt").write_text(LATTE)
    assert cli.main(single) == 0 and [r.output_id for r in files.stored(spark, f"{inbox}/one").collect()] == ["mine"]


def test_dataset_from_folders_without_a_manifest(spark, tmp_path):
    for name, text in (("b", "two"), ("a", "one\r\nline")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "text.txt").write_bytes(text.encode())
    assert cli.main(["dataset", "--output", str(tmp_path), "--dest", f"{tmp_path}/d.jsonl", "--one-file"]) == 0
    assert [json.loads(x)["input"] for x in (tmp_path / "d.jsonl").read_text().splitlines()] == ["one\nline", "two"]


def test_sources(spark, inbox):
    with pytest.raises(FileNotFoundError):
        files.images(spark, f"{inbox}/none")
    assert files.images(spark, f"{inbox}/in/deep/d.txt").count() == 1
    found = {r.path.removeprefix(f"{inbox}/in/"): r.length for r in files.listing(spark, f"{inbox}/in").collect()}
    assert found == {"deep/a.JPG": len(LATTE), "deep/b.png": 2, "deep/c.heic": 1, "deep/d.txt": 1, "deep/.e.webp": 0}
    folder = inbox / "texts" / "r1"
    folder.mkdir(parents=True)
    (folder / "text.txt").write_bytes(b"a\r\nb\rc")
    assert [tuple(r) for r in files.texts(spark, f"{inbox}/texts").collect()] == [("r1", "a\nb\nc")]


def test_stream(spark, inbox):
    q = watch(spark, f"{inbox}/in", f"{inbox}/stream", f"{inbox}/cp")
    q.awaitTermination(120)
    got = {r.output_id: r.status for r in spark.read.parquet(f"{inbox}/stream/texts").collect()}
    assert got == {"a": "low_confidence", "b": "error", "c": "empty"}


def test_ordinals_keep_columns_of_any_name(spark):
    rows = [(i * 7 % 50, f"x{i}", i, -i, "r") for i in range(50)]
    frame = spark.createDataFrame(rows, "k int, _id string, _part int, _before int, row string")
    got = with_ordinal(frame, "k", partitions=5).orderBy("ordinal").collect()
    assert [r.k for r in got] == list(range(50)) and [r.ordinal for r in got] == list(range(50))
    assert all((r["_id"], r["_part"], r["_before"], r["row"]) == (f"x{r['_part']}", r["_part"], -r["_part"], "r") for r in got)


def test_shared_folder_is_asked_for_off_one_machine():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(types.SimpleNamespace(sparkContext=Context()))


class FakeImage:
    def __init__(self, size, tag=1, steps=()):
        self.size, self.tag, self.steps = size, tag, steps

    def load(self):
        pass

    def getexif(self):
        return {pixels.ORIENTATION_TAG: self.tag} if self.tag != 1 else {}

    def convert(self, mode):
        return FakeImage(self.size, 1, (*self.steps, mode))

    def resize(self, size, how):
        return FakeImage(size, 1, (*self.steps, how))

    def rotate(self, degrees, expand, resample):
        return FakeImage(self.size[::-1], 1, (*self.steps, degrees, expand, resample))


def test_pixel_steps_by_a_fake_library(monkeypatch):
    """The libraries are not here: this checks sizes, flags and the order of the calls."""
    pil, ops = types.ModuleType("PIL"), types.ModuleType("PIL.ImageOps")
    pil.Image = types.SimpleNamespace(open=lambda f: FakeImage((100, 400), int(f.read())), LANCZOS="down", BICUBIC="up")
    ops.exif_transpose = lambda x: FakeImage(x.size[::-1] if x.tag != 1 else x.size, 1, ("upright",))
    pil.ImageOps = ops
    monkeypatch.setitem(sys.modules, "PIL", pil)
    monkeypatch.setitem(sys.modules, "PIL.ImageOps", ops)
    pixels._opener.cache_clear()
    monkeypatch.setattr(pixels.PixelPreprocessor, "contrast", lambda self, image: FakeImage(image.size, 1, (*image.steps, self.settings.clahe_clip)))
    for tag, size in ((1, (250, 1000)), (6, (1000, 250))):
        image, report = pixels.PixelPreprocessor().prepare(str(tag).encode())
        assert image.steps == ("upright", "RGB", "up", 2.0) and image.size == size
        assert report["original_size"] == [100, 400] and report["final_size"] == list(size)
        assert (report["exif_transposed"], report["resized"], report["upscaled"], report["contrast_enhanced"]) == (tag != 1, False, True, True)
    image, report = pixels.PixelPreprocessor(Settings(max_long_side=200, clahe_clip=3.0)).prepare(b"1")
    assert image.steps == ("upright", "RGB", "down", 3.0) and image.size == (50, 200) and report["resized"]
    assert pixels.PixelPreprocessor().rotate(image, 90).steps[-3:] == (-90, True, "up")
    pixels._opener.cache_clear()


def test_contrast_by_a_fake_library(monkeypatch):
    """Lightness alone is equalized, with the clip limit and tiles of the settings."""
    import numpy as np

    seen = []
    cv2 = types.SimpleNamespace(
        COLOR_RGB2LAB="in", COLOR_LAB2RGB="out", split=lambda x: [x[..., k] for k in range(3)], merge=lambda x: np.stack(x, axis=-1),
        cvtColor=lambda x, way: seen.append(way) or x,
        createCLAHE=lambda clipLimit, tileGridSize: seen.append((clipLimit, tileGridSize)) or types.SimpleNamespace(apply=lambda light: light + 1),
    )
    monkeypatch.setitem(sys.modules, "cv2", cv2)
    monkeypatch.setattr(pixels, "_opener", lambda: types.SimpleNamespace(fromarray=lambda x: x))
    image = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    got = pixels.PixelPreprocessor(Settings(clahe_clip=3.5)).contrast(image)
    assert seen == ["in", (3.5, (8, 8)), "out"]
    assert (got[..., 0] == image[..., 0] + 1).all() and (got[..., 1:] == image[..., 1:]).all()


def test_exif_flag(spark):
    tags = spark.createDataFrame([(None,), (1,), (0,), (6,), (9,)], "t int")
    assert [r[0] for r in tags.select(images.exif_transposed(F.col("t"))).collect()] == [False, False, True, True, True]
