import numpy as np
import pytest

from cuelark.functions import pixel as px
from cuelark.operators import vision
from cuelark.operators.geometry import Rect
from cuelark.plans.presets import PRESETS
from cuelark.plans.strategies import KEYS

rng = np.random.default_rng(3)


def test_rectangles():
    whole = Rect.source(1920, 1080)
    box = whole.part(0.25, 0.75, 0.5, 1.0)
    assert box.corners == (480, 1440, 540, 1080) and box.size == (960, 540) and box.area == 518_400
    inner = box.part(0, 0.5, 0.1, 0.2)
    assert inner.corners == (480, 960, 594, 648) and inner.seen_from(box).corners == (0, 480, 54, 108)
    assert box.cut(np.zeros((1080, 1920))).shape == (540, 960)
    with pytest.raises(ValueError):
        whole.part(0.6, 0.5, 0, 1)


def test_colours():
    bgr = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255], [0, 0, 0], [10, 20, 30]]], np.uint8)
    assert px.grey(bgr).tolist() == [[29, 150, 76, 255, 0, 22]]
    assert px.hsv(bgr).tolist() == [[[120, 255, 255], [60, 255, 255], [0, 255, 255], [0, 0, 255], [0, 0, 0], [15, 170, 30]]]
    assert px.within(bgr, (0, 0, 200), (255, 255, 255)).tolist() == [[False, False, True, True, False, False]]


def brute_morph(x, kernel, grow):
    kh, kw = kernel.shape
    out = np.empty_like(x)
    for y in range(x.shape[0]):
        for c in range(x.shape[1]):
            seen = []
            for i in range(kh):
                for j in range(kw):
                    a, b = y + i - kh // 2, c + j - kw // 2
                    if grow:
                        a, b = y - (i - kh // 2), c - (j - kw // 2)
                    if kernel[i, j] and 0 <= a < x.shape[0] and 0 <= b < x.shape[1]:
                        seen.append(x[a, b])
            out[y, c] = (max(seen) if grow else min(seen)) if seen else (0 if grow else 255)
    return out


@pytest.mark.parametrize("kernel", [px.rectangle(20, 1), px.rectangle(3, 3), px.ellipse(5, 5), px.ellipse(11, 11), px.ellipse(4, 4), px.ellipse(1, 1)])
def test_morphology_is_that_of_a_plain_loop(kernel):
    x = rng.integers(0, 256, (14, 23)).astype(np.uint8)
    assert (px.dilate(x, kernel) == brute_morph(x, kernel, True)).all()
    assert (px.erode(x, kernel) == brute_morph(x, kernel, False)).all()


def test_derived_morphology():
    x = np.zeros((20, 40), np.uint8)
    x[5:15, 5:15], x[10, 20:38] = 255, 255
    assert (px.strokes_over(x, 3, 5) > 0).sum() == 100 and (px.strokes_under(x, 3, 5) > 0).sum() == 18
    assert (px.opened(x, px.rectangle(3, 3)) > 0).sum() == 100 and px.top_hat(x, px.rectangle(3, 3)).sum() == 18 * 255
    assert (px.near(x, np.roll(x, 2, 0), 5) > 0).sum() == 118
    closed = px.closed(px.mask(np.arange(20)[None] % 4 != 0), px.rectangle(3, 1))
    assert (closed > 0).sum() == 20 - 1 or (closed > 0).all()


def test_components():
    x = np.array([[1, 1, 0, 0, 1], [0, 1, 0, 1, 1], [1, 0, 0, 0, 0], [1, 1, 1, 1, 1]], np.uint8)
    labels, stats = px.components(x)
    assert labels.tolist() == [[1, 1, 0, 0, 2], [0, 1, 0, 2, 2], [3, 0, 0, 0, 0], [3, 3, 3, 3, 3]]
    assert stats.tolist()[1:] == [[0, 0, 2, 2, 3], [3, 0, 2, 2, 3], [0, 2, 5, 2, 6]] and stats[0, 4] == 8
    for _ in range(20):
        x = (rng.random((12, 15)) < 0.55).astype(np.uint8)
        labels, stats = px.components(x)
        for y in range(12):
            for c in range(15):
                for a, b in ((y + 1, c), (y, c + 1)):
                    if a < 12 and b < 15 and x[y, c] and x[a, b]:
                        assert labels[y, c] == labels[a, b]
        for k in range(1, len(stats)):
            seen, todo = set(), [tuple(np.argwhere(labels == k)[0])]
            while todo:
                y, c = todo.pop()
                if (y, c) not in seen and 0 <= y < 12 and 0 <= c < 15 and labels[y, c] == k:
                    seen.add((y, c))
                    todo += [(y + 1, c), (y - 1, c), (y, c + 1), (y, c - 1)]
            assert len(seen) == (labels == k).sum() == stats[k, 4]


def test_filters():
    flat = np.full((9, 11), 77, np.uint8)
    assert (px.sobel(flat, 1, 0) == 0).all() and (px.edges(np.stack([flat] * 3, -1)) == 0).all()
    assert np.allclose(px.box_mean(flat, 301, 101), 77) and np.allclose(px.gaussian_mean(flat, 7), 77)
    step = np.zeros((5, 6), np.uint8)
    step[:, 3:] = 100
    assert px.sobel(step, 1, 0)[2].tolist() == [0, 0, 400, 400, 0, 0] and px.sobel(step, 1, 0, 1)[2].tolist() == [0, 0, 100, 100, 0, 0]
    strong = px.edges(np.stack([step] * 3, -1))[2]
    assert strong.tolist() == [0, 0, 255, 255, 0, 0]
    x = rng.integers(0, 256, (20, 20)).astype(np.uint8)
    assert abs(px.box_mean(x, 5, 3)[10, 10] - x[9:12, 8:13].mean()) < 1e-9
    assert not px.above_local(flat, 7, 0).any() and px.above_local(flat, 7, 3).all()


def test_features():
    x = rng.integers(0, 256, (50, 150)).astype(np.uint8)
    f = px.dct_feature(x)
    assert f.shape == (64,) and abs(np.linalg.norm(f) - 1) < 1e-12 and not px.dct_feature(np.zeros((50, 150))).any()
    full = px.cosines(50, 50) @ x @ px.cosines(150, 150).T
    assert np.allclose(full[:8, :8].ravel() / np.linalg.norm(full[:8, :8]), f) and np.allclose(np.linalg.norm(full), np.linalg.norm(x.astype(float)))
    assert px.image_of(f, 150, 50).max() == 255
    assert px.resized(x, 150, 50).tolist() == x.tolist() and (px.resized(np.full((10, 7), 9, np.uint8), 150, 50) == 9).all()
    mean, v = px.principal_components(rng.random((30, 6)), 4)
    assert np.allclose(v @ v.T, np.eye(4)) and px.projected(mean, mean, v).tolist() == [0] * 4


def test_clusters():
    points = np.array([[0.0], [0.1], [5.0], [5.2], [9.0]])
    assert px.clusters(points, 1.0).tolist() == [0, 0, 1, 1, 2] and len(set(px.clusters(points, 100.0))) == 1
    assert px.clusters(np.zeros((1, 3)), 1.0).tolist() == [0]
    assert np.allclose(px.standardised(np.array([[1.0, 5], [3, 5]])), [[-1, 0], [1, 0]])


def frame(height=270, width=480, ground=0):
    return np.full((height, width, 3), ground, np.uint8)


def flags(key, image, preset=None, **extra):
    params = PRESETS[key][preset or next(iter(PRESETS[key]))]
    values = {k: v for k, v in params.items() if not k.endswith("Rect") and k != "debugLevel" and not k.startswith(("featureJump", "jumpThresh", "fillGap", "iirPass"))}
    return vision.STRATEGIES[key][0](image, vision.rectangles(key, params, image.shape[1], image.shape[0]), **values, **extra)


@pytest.mark.parametrize("key", KEYS)
def test_every_strategy_reads_any_frame(key):
    names = {f.name for f in vision.STRATEGIES[key][1]}
    for image in (frame(), frame(ground=255), rng.integers(0, 256, (135, 240, 3)).astype(np.uint8)):
        assert set(flags(key, image)) == names


def test_text_on_black_and_white():
    black = frame()
    black[130:134, 200:280] = 255
    f = flags("mr", black)
    assert f["Blackscreen"] and not f["Whitescreen"] and not f["Dialog"]
    white = frame(ground=255)
    white[130:136, 150:280] = 0
    assert flags("mr", white)["Whitescreen"]
    assert flags("mr-s0", black)["Blackscreen"]


def test_box_of_a_band():
    image = frame(ground=40)
    box = Rect.source(480, 270).part(*PRESETS["bdr"]["default"]["dialogRect"])
    box.cut(image)[:] = 245
    box.cut(image)[10:14, 40:200] = 20
    f = flags("bdr", image)
    assert f["Dialog"] and 200 < f["DialogBgVal"] < 255 and f["DialogTextVal"] > 0.5
    assert not flags("bdr", frame(ground=40))["Dialog"]


def test_outlined_letters():
    image = frame(540, 960, 90)
    for x in range(300, 600, 40):
        image[450:482, x : x + 22] = 0
        image[454:478, x + 4 : x + 18] = 255
    f = flags("otl", image)
    assert f["Dialog"] and abs(np.linalg.norm(f["DialogFeat"]) - 1) < 1e-9
    bare = frame(540, 960, 90)
    assert not flags("otl", bare)["Dialog"] and not any(flags("otl", bare)["DialogFeat"])


def test_boxes_of_colour():
    roi = frame(60, 300, 30)
    for x in range(20, 280, 30):
        roi[15:45, x : x + 18] = (40, 220, 250)
    detector = lambda image: [[(5, 5), (290, 5), (290, 50), (5, 50)], [(0, 0), (9, 9), (9, 18), (0, 9)]]
    image = frame(80, 300, 30)
    image[20:, :] = roi
    f = flags("bcs", image, detector=detector)
    assert len(vision.upright_boxes(detector(roi), 300, 60, 0.05)) == 1 and set(f) == {"Dialog", "DialogVal", "DialogFeat"}
    params = PRESETS["bcs"]["default"] | {"maxCcAreaRatio": 0.9, "maxGreyscalePenalty": 0.9}
    found = vision.box_text(roi, params)
    assert (found[30, 25] == 255) and found[30, 45] == 0
    assert not vision.box_text(frame(30, 30, 9), params).any()


def test_bubbles():
    image = frame(270, 480, 10)
    box = Rect.source(480, 270).part(*PRESETS["md"]["default"]["leftBubbleRect"])
    cut = box.cut(image)
    cut[:, : int(cut.shape[1] * 0.7)] = (213, 223, 229)
    cut[8:14, 10:40] = 20
    f = flags("md", image)
    assert f["LeftBubble"] and not f["RightBubble"]


PIXEL_QUERIES = [*[f"pixel_{k.replace('-', '_')}" for k in KEYS], "component_filter", "dct_descriptor", "rgb_sobel", "framewise_pixels", "interval_texts", "pixels_to_subtitles"]


@pytest.mark.parametrize("name", PIXEL_QUERIES)
def test_no_pixel_leaves_its_worker(spark, name):
    """Rows that go to and from workers have what draws a picture; 10,000 rows of pixels are 622 MB."""
    from cuelark.plans import catalogue

    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "img" not in plan and "feat" in plan


def test_a_picture_is_worked_out_once(spark):
    from pyspark.sql import types as T

    calls = []

    def run(x):
        calls.append(1)
        return {"total": int(x.sum()), "row": x[0, :, 0].astype(float).tolist()}

    images = [rng.integers(0, 256, (4, 5, 3)).astype(np.uint8) for _ in range(3)]
    of = vision.ByPicture(run)
    for i in (0, 1, 2, 0, 1, 2):
        assert of(images[i]) == run(images[i])
    assert len(calls) == 6 + 3
    assert of(images[0].reshape(5, 4, 3)) == run(images[0].reshape(5, 4, 3))  # the same bytes in another shape
    images[0][0, 0, 0] ^= 1
    assert of(images[0]) == run(images[0])  # an image that changed in its place
    rows = [(1 + i % 2, i, i, i % 25 == 0, *images[i % 3].shape[:2], bytearray(images[i % 3].tobytes())) for i in range(150)]
    frames = spark.createDataFrame([*rows, (3, 0, 0, True, None, None, None)], "video_id long, pts long, frame_idx long, is_key boolean, h int, w int, img binary")
    columns = T.StructType.fromDDL("total int, row array<double>")
    fetch = lambda pdf: lambda i: images[pdf["frame_idx"][i] % 3]
    want = sorted((1 + i % 2, i, int(x.sum()), x[0, :, 0].astype(float).tolist()) for i in range(150) for x in [images[i % 3]])
    stored = vision.each_frame(frames, ["video_id", "frame_idx"], run, columns)
    fetched = vision.each_frame(frames.where("img is not null").select("video_id", "frame_idx"), ["video_id", "frame_idx"], run, columns, fetch)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, fetched.collect())) == want


def test_kept_pictures_have_a_bound(monkeypatch):
    monkeypatch.setattr(vision, "KEPT_BYTES", 100)
    calls = []
    of = vision.ByPicture(lambda x: calls.append(1) or int(x.sum()))
    small = [np.full((2, 5, 3), i, np.uint8) for i in range(5)]
    for x in (*small, *small, small[4], small[3]):
        assert of(x) == int(x.sum())
    assert len(calls) == 10 and of.held == 90 and len(of.kept) == 3
    large = np.ones((7, 5, 3), np.uint8)
    assert of(large) == of(large) == 105 and len(calls) == 12 and of.held == 90


def test_a_worker_keeps_pictures_for_its_next_task():
    from pyspark import cloudpickle

    calls = []
    monday, tuesday = vision.ByPicture(lambda x: int(x.sum()) + 1), vision.ByPicture(lambda x: int(x.sum()) + 2)
    sent = cloudpickle.dumps(monday)
    first = cloudpickle.loads(sent)
    first.run = lambda x: calls.append(1) or 7
    x = np.ones((2, 2, 3), np.uint8)
    again = cloudpickle.loads(sent)
    assert first(x) == again(x) == 7 and calls == [1]
    assert cloudpickle.loads(cloudpickle.dumps(tuesday))(x) == 14  # another function has pictures of its own
    assert cloudpickle.loads(sent)(x) == 13


def test_drawn_rows_go_in_small_batches():
    import pandas as pd

    from cuelark.sources import pictures

    class Frames:
        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):
            n = 1000
            return list(run([pd.DataFrame({"video_id": 1, "pts": range(n), "frame_idx": range(n), "is_key": True, "feat": np.arange(n) / 3})]))

    parts = pictures.drawn_frames(Frames())
    assert max(map(len, parts)) == 64 and [i for p in parts for i in p.frame_idx] == list(range(1000))
    assert all(img == pictures.drawn(i / 3) for p in parts for i, img in zip(p.frame_idx, p.img, strict=True))
