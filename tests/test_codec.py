import numpy as np
import pytest

from blockweave.functions.tables import quant_table
from blockweave.plans import codec
from blockweave.sources import container, images


def clip(n, h, w, ch, seed=1):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    base = np.dstack([(x * 5 + y * 3 + c * 40) % 256 for c in range(ch)])
    return [np.clip(base + rng.integers(-4, 5, base.shape) + 3 * t, 0, 255).astype(np.uint8) for t in range(n)]


def frames(spark, pics):
    rows = [(i, p.tobytes()) for i, p in enumerate(pics)]
    return spark.createDataFrame(rows, "frame_idx int, data binary")


@pytest.mark.parametrize("h,w,ch,ycbcr,mode", [(1, 1, 3, True, "window"), (9, 7, 3, True, "exact"), (17, 16, 3, False, "window"), (8, 8, 1, True, "window"), (10, 13, 2, True, "exact")])
def test_roundtrip_stays_within_the_quantisers_error(spark, h, w, ch, ycbcr, mode):
    pics = clip(3, h, w, ch)
    chunks = codec.encode(frames(spark, pics), w, h, ch, 90, ycbcr, mode)
    back = codec.decode(chunks, container.Header(w, h, ch, 90, 3, int(ycbcr))).orderBy("frame_idx").collect()
    assert len(back) == 3
    for r, p in zip(back, pics):
        v = np.frombuffer(r.data, np.uint8).reshape(h, w, ch).astype(int)
        if not (ycbcr and ch == 3):
            # every coefficient is off by half a divisor at most
            worst = [sum(quant_table(90, c == 0)) / 2 / 4 + 1 for c in range(ch)]
            assert (np.abs(v - p).max(axis=(0, 1)) <= np.array(worst)).all()
        assert np.sqrt(((v - p) ** 2).mean()) < (45 if ycbcr and ch == 3 else 4)


def test_folder_to_container_and_back(spark, tmp_path):
    pics = clip(12, 9, 10, 3)
    (tmp_path / "in").mkdir()
    for i, p in enumerate(pics):
        (tmp_path / "in" / f"frame{i:02d}.png").write_bytes(images.encode_png(p))
    head = codec.compress(spark, str(tmp_path / "in"), str(tmp_path / "out.bin"), quality=80)
    assert head == container.Header(10, 9, 3, 80, 12, 1)
    assert codec.decompress(spark, str(tmp_path / "out.bin"), str(tmp_path / "back")) == 12
    names = sorted(p.name for p in (tmp_path / "back").iterdir())
    assert names == [f"frame_{i:04d}.png" for i in range(12)]
    assert images.decode((tmp_path / "back" / names[0]).read_bytes()).shape == (9, 10, 3)
    head, chunks = container.read(spark, str(tmp_path / "out.bin"))
    assert container.summary(chunks, head).first().frames == 12
    raw = (tmp_path / "out.bin").read_bytes()
    for bad in (raw[:20], b"NOPE" + raw[4:], raw[:-5]):
        (tmp_path / "bad.bin").write_bytes(bad)
        with pytest.raises(container.ContainerError):
            container.index(str(tmp_path / "bad.bin"))


def test_options():
    for q in (0, 101, "50", 5.0, True):
        with pytest.raises(ValueError):
            codec.check_options(q)
    with pytest.raises(ValueError):
        codec.check_options(50, 4)


def test_images_of_every_kind(tmp_path):
    for ch in (1, 2, 3, 4):
        p = clip(1, 5, 6, ch)[0]
        assert (images.decode(images.encode_png(p)) == p).all()
    p = clip(1, 5, 6, 3)[0]
    assert (images.decode(images.encode_by_name("a.BMP", p)) == p).all()
    assert (images.decode(b"P6 # c\n6 5\n255\n" + p.tobytes()) == p).all()
    with pytest.raises(images.ImageError):
        images.decode(b"plain text")


def test_png_filters_and_low_depths():
    import struct
    import zlib

    def png(w, h, depth, colour, rows, extra=b"", interlace=0):
        chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
        return images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlace)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

    gray = np.array([[10, 20, 30], [15, 25, 40], [9, 8, 7]], np.uint8)
    rows = bytes([1, 10, 10, 10]) + bytes([2, 5, 5, 10]) + bytes([0, 9, 8, 7])
    assert (images.decode(png(3, 3, 8, 0, rows))[:, :, 0] == gray).all()
    paeth = bytes([0, 10, 20, 30]) + bytes([4, 5, 5, 10])
    assert images.decode(png(3, 2, 8, 0, paeth))[1, :, 0].tolist() == [15, 25, 40]
    average = bytes([0, 10, 20, 30]) + bytes([3, 10, 8, 13])
    assert images.decode(png(3, 2, 8, 0, average))[1, :, 0].tolist() == [15, 25, 40]
    assert images.decode(png(8, 1, 1, 0, bytes([0, 0b10100000])))[0, :, 0].tolist() == [255, 0, 255, 0, 0, 0, 0, 0]
    assert images.decode(png(2, 1, 16, 0, bytes([0, 200, 1, 7, 255])))[0, :, 0].tolist() == [200, 7]


def test_folders(spark, tmp_path):
    with pytest.raises(images.ImageError):
        images.read_frames(spark, str(tmp_path / "none"))
    folder = tmp_path / "f"
    folder.mkdir()
    for i in (1, 2, 10):
        (folder / f"frame{i}.png").write_bytes(images.encode_png(np.full((2, 2, 3), i, np.uint8)))
    by = lambda order: [r.data[0] for r in images.read_frames(spark, str(folder), order).orderBy("frame_idx").collect()]
    assert by("path") == [1, 10, 2] and by("numeric") == [1, 2, 10]
    assert [bytes(r.data)[:3] for r in images.read_jvm(spark, str(folder), "numeric").orderBy("frame_idx").collect()] == [bytes([i] * 3) for i in (1, 2, 10)]
    (folder / "x.png").write_bytes(images.encode_png(np.zeros((3, 2, 3), np.uint8)))
    with pytest.raises(Exception, match="first frame"):
        images.read_frames(spark, str(folder)).collect()


def test_channels():
    rgb = np.array([[[10, 20, 30]]], np.uint8)
    assert images.with_channels(rgb, 1).ravel().tolist() == [(77 * 10 + 150 * 20 + 29 * 30) >> 8]
    assert images.with_channels(rgb, 4).ravel().tolist() == [10, 20, 30, 255]
    assert images.with_channels(np.array([[[9, 8]]], np.uint8), 3).ravel().tolist() == [9, 9, 9]
    assert images.with_channels(np.array([[[9, 8]]], np.uint8), 4).ravel().tolist() == [9, 9, 9, 8]
    with pytest.raises(images.ImageError):
        images.with_channels(rgb, 5)


def test_command_line(spark, tmp_path, capsys):
    from blockweave.__main__ import main, parser

    for bad in (["compress", "a", "b", "-q", "0"], ["compress", "a", "b", "-q", "x"], ["other"], []):
        with pytest.raises(SystemExit):
            parser().parse_args(bad)
    a = parser().parse_args(["compress", "a", "b", "--no-ycbcr"])
    assert (a.quality, a.ycbcr) == (50, False)
    (tmp_path / "in").mkdir()
    for i in (2, 10):
        (tmp_path / "in" / f"f{i}.png").write_bytes(images.encode_png(clip(1, 8, 8, 3, i)[0]))
    assert main(["manifest", str(tmp_path / "in")]) == 0
    assert [x.split("/")[-1] for x in capsys.readouterr().out.split("\n") if x] == ["f2.png", "f10.png"]
    assert main(["compress", str(tmp_path / "in"), str(tmp_path / "c.bin"), "-q", "75", "--order", "numeric"]) == 0
    assert main(["decompress", str(tmp_path / "c.bin"), str(tmp_path / "out")]) == 0
    assert len(list((tmp_path / "out").iterdir())) == 2
    (tmp_path / "bad.bin").write_bytes(b"no")
    assert main(["decompress", str(tmp_path / "bad.bin"), str(tmp_path / "out")]) == 1


def jpeg(spark, path, pixels):
    """A JPEG file by the JVM's writer."""
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(pixels.shape[1], pixels.shape[0], 1)
    for y, x in np.ndindex(pixels.shape[:2]):
        image.setRGB(x, y, int(pixels[y, x, 0]) << 16 | int(pixels[y, x, 1]) << 8 | int(pixels[y, x, 2]))
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(path)))


def test_jpeg_frames_are_compressed(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    for i in (1, 2):
        jpeg(spark, folder / f"a{i}.jpg", np.full((16, 16, 3), 60 * i, np.uint8))
    (folder / "a3.png").write_bytes(images.encode_png(np.full((16, 16, 3), 200, np.uint8)))
    rows = images.read_frames(spark, str(folder)).orderBy("frame_idx").collect()
    assert [(r.width, r.height, r.channels) for r in rows] == [(16, 16, 3)] * 3
    assert all(abs(np.frombuffer(r.data, np.uint8).astype(int) - v).max() <= 3 for r, v in zip(rows, (60, 120, 200)))
    head = codec.compress(spark, str(folder), str(tmp_path / "c.bin"), quality=90)
    assert head.frame_count == 3 and codec.decompress(spark, str(tmp_path / "c.bin"), str(tmp_path / "out")) == 3
    (folder / "b.png").write_bytes(images.encode_png(np.full((8, 8, 3), 1, np.uint8)))
    with pytest.raises(Exception, match="first frame"):
        images.read_frames(spark, str(folder)).collect()
