import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuelark.operators import recognise, vision
from cuelark.plans import presets
from cuelark.plans.strategies import KEYS, framewise, plan, speculative
from cuelark.sinks import subtitles
from cuelark.sources import config
from cuelark.sources.raw_video import RawFrames, image_of

TEXT = """
source: [a.mp4, b.mp4]
destination: [a, b]
strategy: otl
preset: zundahouse
engine: speculative
speculative: {emptyGapForceCheck: 1000}
extraJobs: [ocr]
ocr: {suffix: -ocr.txt, separator: "@", doPaddle: true, paddleLang: japan, doTesseract: false, tesseractLang: jpn}
"""


def test_a_right_configuration():
    run = config.parse(TEXT)
    assert run.sources == ("a.mp4", "b.mp4") and run.params["sobelThreshold"] == 230 and run.empty_gap == 1000
    assert run.plan.key == "otl" and run.ocr["separator"] == "@"
    for key in KEYS:
        for name in presets.PRESETS[key]:
            config.check_params(key, presets.PRESETS[key][name])


@pytest.mark.parametrize(
    ("old", "new", "says"),
    [
        ("[a, b]", "[a]", "source and destination"),
        ("strategy: otl", "strategy: xyz", "strategy"),
        ("preset: zundahouse", "preset: none", "preset"),
        ("engine: speculative", "engine: magic", "engine"),
        ("preset: zundahouse\n", "", "missing"),
        ("strategy: otl\npreset: zundahouse", "strategy: mr\npreset: default", "does not run"),
        ("emptyGapForceCheck: 1000", "emptyGapForceCheck: -1", "not in"),
        ("source: [a", "colour: 1\nsource: [a", "unknown"),
        ('separator: "@", ', "", "ocr.separator"),
        ("preset: zundahouse", "preset: mine\notl: {mine: {dialogRect: [0.9, 0.1, 0, 1]}}", "missing"),
    ],
)
def test_wrong_configurations(old, new, says):
    with pytest.raises(config.ConfigError, match=says):
        config.parse(TEXT.replace(old, new))


def test_wrong_parameters():
    good = presets.PRESETS["otl"]["hotelzdm"]
    for bad, says in (({"dialogRect": [0.9, 0.1, 0, 1]}, "over"), ({"dialogRect": [0, 1, 0]}, "four"), ({"textHSVRanges": [[0, 0, 0, 181, 0, 0]]}, "not in"), ({"fastMode": 1}, "true"), ({"extra": 1}, "unknown"), ({"textWeightMin": 1.5}, "whole")):
        with pytest.raises(config.ConfigError, match=says):
            config.check_params("otl", good | bad)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    home = tmp_path_factory.mktemp("raw")
    for video in (1, 2):
        img = np.zeros((200, 12, 16, 3), np.uint8)
        img[:, :, :, 0] = np.arange(200)[:, None, None]
        beside = {} if video == 2 else {"img": img}  # pixels in the same file, and in one of their own
        np.savez(home / f"{video}.npz", pts=np.arange(200) * 40, key=np.arange(200) % 50 == 0, **beside)
        if video == 2:
            np.save(home / "2.npy", img)
    (home / "notes.txt").write_text("no video")
    return str(home)


def test_raw_frames(spark, folder):
    spark.dataSource.register(RawFrames)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("raw_frames").option("segment", 60).load(folder)
    assert df.count() == 400 and df.rdd.getNumPartitions() == 4
    part = df.where((F.col("video_id") == 2) & (F.col("pts") >= 400) & (F.col("pts") < 800))
    assert sorted(r.frame_idx for r in part.collect()) == list(range(10, 20))
    thin = spark.read.format("raw_frames").option("every", 10).load(folder)
    assert {r.frame_idx for r in thin.collect()} == set(range(0, 200, 10))
    assert set(df.where("frame_idx = 7").select("img").first()[0][::3]) == {7}


def captions(video, count=260):
    """Frames with a caption box over some spans."""
    rows = []
    for i in range(count):
        img = np.full((60, 96, 3), 40, np.uint8)
        if 40 <= i < 130 or 150 <= i < 240:
            img[49:58, 6:90] = 250
            img[52:53, 10 : (50 if i < 140 else 70)] = 10
        rows.append((video, 40 * i, i, i % 25 == 0, 60, 96, bytearray(img.tobytes())))
    return rows


def test_from_pixels_to_subtitles(spark, tmp_path):
    from cuelark.functions.timebase import TimeBase

    ms = TimeBase(1, 1000)
    frames = spark.createDataFrame(captions(1) + captions(2), "video_id long, pts long, frame_idx long, is_key boolean, h int, w int, img binary")
    params = presets.PRESETS["bdr"]["default"]
    found = framewise(vision.analyse(frames, "bdr", params), plan("bdr", params), ms)
    got = [(r.video_id, r.begin, r.end) for r in found.orderBy("video_id", "begin").collect()]
    assert [v for v, *_ in got] == [1, 1, 2, 2] and got[0][1] == 1600
    lines = subtitles.document_lines(found, ("Style: A",), ms)
    assert lines.where("video_id = 1").count() == len(subtitles.HEADER) + 1 + len(subtitles.EVENTS) + 2
    subtitles.write_documents(found, str(tmp_path / "out"), base=ms)
    written = spark.read.text(str(tmp_path / "out" / "video_id=1")).collect()
    assert written[0][0] == "[Script Info]" and written[-1][0].endswith("Subtitle_Dialog_1")
    texts = recognise.interval_texts(found, frames, [lambda image, mask: "seen", lambda image, mask: recognise.one_line("a\nb\n\f")])
    assert {r.text for r in texts.collect()} == {"seen@ab"}
    sizes = [lambda image, mask: "", lambda image, mask: f"{image.shape[1]}x{image.shape[0]} {mask.shape[1]}x{mask.shape[0]}"]
    texts = recognise.interval_texts(found, frames, sizes, crop=lambda image: image[10:30, 5:45], text_mask=lambda crop: crop[..., 0])
    assert {r.text for r in texts.collect()} == {"40x20 40x20"}  # no separator before the first text; the mask is the crop's
    texts = recognise.interval_texts(found, frames, [lambda image, mask: "seen", lambda image, mask: recognise.one_line("a\nb\n\f")])
    assert subtitles.ocr_lines(texts).where("video_id = 2").orderBy("ord").first().line == "Subtitle_Dialog_0,seen@ab"


def test_sparse_plan_over_features(spark):
    from cuelark.functions.timebase import TimeBase

    ms = TimeBase(1, 1000)
    def feature(i):
        v = [0.0] * 64
        if 100 <= i < 300 or 320 <= i < 500:
            v[3 if i < 310 else 5] = 1.0
        return v

    rows = [(1, 40 * i, i, i % 60 == 0, any(feature(i)), feature(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "video_id long, pts long, frame_idx long, is_key boolean, Dialog boolean, DialogFeat array<double>")
    got = [(r.begin // 40, r.end // 40) for r in speculative(df, plan("otl", {"featureJumpThreshold": 0.1}), 10**6, ms).orderBy("begin").collect()]
    assert got == [(100, 300), (320, 500)]
    frame_by_frame = [(r.begin // 40, r.end // 40) for r in framewise(df, plan("otl", {}), ms).orderBy("begin").collect()]
    assert len(frame_by_frame) == 2 and all(abs(a - c) <= 6 and abs(b - d) <= 6 for (a, b), (c, d) in zip(got, frame_by_frame, strict=True))
    with pytest.raises(ValueError):
        speculative(df, plan("lcb"), base=ms)


def test_joined_lines():
    assert recognise.joined_lines([["a", "b"], ["c"], []]) == "ab\nc"


def test_a_whole_run(spark, tmp_path):
    from cuelark import runner
    from cuelark.functions.timebase import TimeBase

    home = tmp_path / "in"
    home.mkdir()
    for video in (1, 2):
        rows = captions(video)
        np.savez(home / f"{video}.npz", pts=[r[1] for r in rows], key=[r[3] for r in rows], img=np.stack([np.frombuffer(bytes(r[6]), np.uint8).reshape(60, 96, 3) for r in rows]))
    run = config.parse(f"{{source: [{home}], destination: [{tmp_path / 'out'}], strategy: bdr, preset: default, engine: framewise, framewise: {{sampleInterval: 2}}}}")
    assert len(runner.execute(spark, run, TimeBase(1, 1000))) == 1
    lines = [r[0] for r in spark.read.text(str(tmp_path / "out" / "subtitles" / "video_id=2")).collect()]
    assert sum(x.startswith("Dialogue") for x in lines) == 2
    sparse = config.parse(f"{{source: [{home}], destination: [x], strategy: prk, preset: default, engine: speculative}}")
    frames = spark.read.format("raw_frames").load(str(home))
    work = runner.work_of(frames, sparse, TimeBase(1, 1000)).first()
    assert work.n_frames == 520 and work.n_analysed < work.n_decoded < work.n_frames
    whole = runner.intervals_of(frames, sparse, TimeBase(1, 1000))
    assert whole.count() >= 2
    bare = spark.read.format("raw_frames").option("pixels", "false").load(str(home))
    assert {r.h for r in bare.collect()} == {0}
    lazy = runner.intervals_of(bare, sparse, TimeBase(1, 1000), image_of(str(home)))
    assert sorted(map(str, lazy.collect())) == sorted(map(str, whole.collect()))


def test_sparse_looks_read_few_pixels(spark, tmp_path):
    """Only the frames looked at are fetched: all others may be missing."""
    from cuelark.plans import presets
    from cuelark.operators import speculative as sp, vision

    params = next(iter(presets.PRESETS["prk"].values()))
    img = np.zeros((240, 60, 96, 3), np.uint8)
    img[100:200, 54:58, 10:60] = 255
    fetched = []

    def of(pdf):
        def image(i):
            fetched.append(i)
            return img[i]

        return image

    look = vision.looks("prk", params, "Dialog", "DialogFeat", of)
    video = sp.Video(np.arange(240) * 40, np.arange(240) % 60 == 0, look(None), 0.1, 10**9)
    spans = [(g.begin // 40, g.end // 40) for g in video.run() if g.first_main]
    assert spans == [(100, 200)] and len(fetched) == len(set(fetched)) == video.analysed < 24
    assert video.analysed < video.decoded < 240


def test_videos_come_whole_out_of_any_batches():
    """Short videos share a batch of results, which are the work of one call each a batch; a long one spans batches."""
    from cuelark.operators import speculative as sp

    lengths = {None: 3, 1: 1, 2: 40, 3: 7, 4: 2, 5: 11}
    rows = [(v, 10 * (i - i % 2), i, i % 5 == 0, float(v or 0) + i // 6) for v, n in lengths.items() for i in range(n)]
    table = pa.table({c: [r[k] for r in rows] for k, c in enumerate(("video_id", "pts", "frame_idx", "is_key", "feat"))})

    def look_of(pdf):
        assert list(pdf.index) == list(range(len(pdf))) and not pdf.pts.duplicated().any()
        return lambda i: (True, np.array([pdf["feat"][i]]))

    whole = None
    for size in (1, 2, 3, 7, 64):
        batches = [b for a in range(0, len(rows), size) for b in table.slice(a, size).combine_chunks().to_batches()] + table.slice(0, 0).to_batches()
        out = list(sp._looks(iter(batches), look_of, "on", 0.5, 1 << 60))
        assert len(out) <= len(batches) + 1 and all(b.schema == sp.ARROW for b in out)
        got = [tuple(map(str, r.values())) for b in out for r in b.to_pylist()]
        whole = whole or got
        assert got == whole
    works = {r["video_id"]: r for b in out for r in b.to_pylist() if r["seq"] == -1}
    assert {v: r["n_frames"] for v, r in works.items()} == {v: (n + 1) // 2 for v, n in lengths.items()}
    assert sum(len(b) for b in sp._looks(iter([]), look_of, "on", 0.5, 1)) == 0


def test_projection_models(spark, tmp_path):
    from cuelark.functions import pixel
    from cuelark.sources import models

    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, 6)) * [9, 5, 3, 2, 0.1, 0.1]
    df = spark.createDataFrame([(1, i, i, data[i].tolist()) for i in range(300)], "video_id long, pts long, frame_idx long, f array<double>")
    mean, vectors = models.train_projection(df, "f", every=3)
    want, other = pixel.principal_components(data[::3], 4)
    assert np.allclose(mean, want) and np.allclose(np.abs((vectors * other).sum(1)), 1)
    models.save_projection(str(tmp_path / "m.npz"), mean, vectors)
    again = models.load_projection(str(tmp_path / "m.npz"))
    assert np.allclose(again[0], mean) and np.allclose(again[1], vectors)
