"""Members that a bulk read damages are read again, alone."""

from pyarrow import fs

from quarrykit.llm import media


class Damaging:
    """A file whose first bulk read has one byte wrong."""

    def __init__(self, inner, at, left):
        self.inner, self.at, self.left = inner, at, left

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.inner.close()

    def seek(self, n):
        self.inner.seek(n)

    def read(self, n):
        start = self.inner.tell()
        data = self.inner.read(n)
        if self.left and start <= self.at < start + len(data):
            self.left.pop()
            data = data[: self.at - start] + bytes([data[self.at - start] ^ 255]) + data[self.at - start + 1 :]
        return data


def test_members_damaged_in_a_bulk_read_are_read_again(monkeypatch, tmp_path):
    writer = media.ArchiveWriter(f"file://{tmp_path}", "part-0", 1)
    bodies = [media.encode_png(media.payload("text %d " % i * 40)[0]) for i in range(20)]
    for i, b in enumerate(bodies):
        writer.add(f"{i}.{i}.png", b)
    writer.close()
    reader = media.ArchiveReader(f"file://{tmp_path}")
    (part,) = reader.partitions()
    clean = [row for batch in reader.read(part) for row in batch.to_pylist()]
    left = [1]

    class Files:
        def open_input_file(self, path):
            return Damaging(fs.LocalFileSystem().open_input_file(path), clean[7]["member_offset"] + 512 + 50, left)

    monkeypatch.setattr(media, "_opened", lambda uri: (Files(), uri))
    got = [row for batch in reader.read(part) for row in batch.to_pylist()]
    assert not left and got == clean and [r["media"] for r in got] == bodies


def test_intact():
    png = media.encode_png(media.payload("some text")[0])
    assert media.intact(png)
    assert not media.intact(b"") and not media.intact(png[:-1]) and not media.intact(png + b"x")
    assert not any(media.intact(png[:i] + bytes([png[i] ^ 1]) + png[i + 1 :]) for i in range(len(png)))
