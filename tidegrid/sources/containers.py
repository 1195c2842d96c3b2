"""Headers of recording containers: where the samples lie, what they are, and what is said of rate and frequency.

Each reader gets read(offset, count) and the size of a file and looks at headers
only. What a header says beyond the file's end is cut back with a warning.
"""

import ast
import json
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from . import formats

Read = Callable[[int, int], bytes]


class BadHeader(ValueError):
    """A file that says what it is, but not in a form that can be read."""


@dataclass
class Recording:
    container: str
    name: str
    datatype: str | None
    segments: list[tuple[int, int]]  # offset and length in bytes, in the order of the samples
    rate: float | None = None
    frequency: float | None = None
    channels: int = 1
    file: str | None = None  # another file that holds the samples
    warnings: list[str] = field(default_factory=list)

    @property
    def samples(self) -> int | None:
        return sum(n for _, n in self.segments) // formats.parse(self.datatype).sample_bytes if self.datatype else None


def clamp(offset: int, stated: int, size: int, what: str) -> tuple[int, list[str]]:
    """The bytes that are there of those that a header states."""
    there = max(0, size - offset)
    return (stated, []) if stated <= there else (there, [f"{what} states {stated} bytes but only {there} are there"])


def _unpack(form: str, data: bytes) -> tuple:
    if len(data) < struct.calcsize(form):
        raise BadHeader("the header ends early")
    return struct.unpack_from(form, data)


# SigMF


def _positive(x, what: str, warnings: list[str]) -> float | None:
    if x is None:
        return None
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not 0 < x < float("inf"):
        warnings.append(f"{what} is not a positive number")
        return None
    return float(x)


def sigmf(meta: bytes, size: int, name: str, base: int = 0) -> Recording:
    """From the metadata and the size of the dataset, which begins at base."""
    try:
        doc = json.loads(meta)
        main, captures = doc["global"], doc.get("captures") or [{}]
        kind = formats.parse(main["core:datatype"])
    except (ValueError, KeyError, TypeError) as e:
        raise BadHeader(f"not SigMF metadata: {e}") from e
    warnings: list[str] = []
    channels = main.get("core:num_channels", 1)
    if channels != 1:
        raise BadHeader(f"{channels} channels in one dataset are not read")
    width, trailing = kind.sample_bytes, int(main.get("core:trailing_bytes", 0))
    starts = [int(c.get("core:sample_start", 0)) for c in captures]
    skips = [int(c.get("core:header_bytes", 0)) for c in captures]
    if starts != sorted(starts) or min(starts + skips) < 0:
        raise BadHeader("captures are not in order")
    segments, skipped, end = [], 0, size - trailing
    for k, start in enumerate(starts):
        skipped += skips[k]
        offset = start * width + skipped
        until = starts[k + 1] * width + skipped if k + 1 < len(starts) else end
        count, more = clamp(offset, max(0, until - offset), end, f"capture {k}")
        warnings += more
        segments.append((base + offset, count - count % width))
    frequency = _positive(captures[0].get("core:frequency"), "core:frequency", warnings)
    return Recording("SigMF", name, kind.name, segments, _positive(main.get("core:sample_rate"), "core:sample_rate", warnings), frequency, warnings=warnings)


def tar_members(read: Read, size: int) -> list[tuple[str, int, int]]:
    """name, offset, size of the files of a tar archive, read in place."""
    out, at = [], 0
    while at + 512 <= size:
        head = read(at, 512)
        if not head.strip(b"\0"):
            break
        name = head[:100].split(b"\0")[0].decode("utf-8", "replace")
        if head[257:262] == b"ustar" and head[345:500].strip(b"\0"):
            name = head[345:500].split(b"\0")[0].decode("utf-8", "replace") + "/" + name
        try:
            n = int.from_bytes(head[125:136], "big") if head[124] & 0x80 else int(head[124:136].strip(b"\0 ") or b"0", 8)
        except ValueError as e:
            raise BadHeader("not a tar archive") from e
        if head[156:157] in (b"0", b"\0"):
            out.append((name, at + 512, n))
        at += 512 + -(-n // 512) * 512
    return out


def sigmf_archive(read: Read, size: int) -> list[Recording]:
    members = {name: (at, n) for name, at, n in tar_members(read, size)}
    out = []
    for name, (at, n) in sorted(members.items()):
        if name.endswith(".sigmf-meta"):
            data = members.get(name.removesuffix("meta") + "data")
            if data is None:
                raise BadHeader(f"{name} has no dataset in the archive")
            out.append(sigmf(read(at, n), data[1], name, data[0]))
    if not out:
        raise BadHeader("no recording in the archive")
    return out


# The WAV family

#: Identifiers of the 64-bit form.
W64 = {"riff": bytes.fromhex("726966662E91CF11A5D628DB04C10000"), "wave": bytes.fromhex("77617665F3ACD3118CD100C04F8EDB8A"), "fmt ": bytes.fromhex("666D7420F3ACD3118CD100C04F8EDB8A"), "data": bytes.fromhex("64617461F3ACD3118CD100C04F8EDB8A")}
PCM, IEEE_FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def _chunks(read: Read, size: int) -> tuple[str, dict[str, tuple[int, int]]]:
    """The byte order, and offset and stated size of each first chunk of a kind."""
    head, found = read(0, 40), {}
    if head[:16] == W64["riff"] and head[24:40] == W64["wave"]:
        at = 40
        while at + 24 <= size:
            h = read(at, 24)
            name = next((k for k, v in W64.items() if v == h[:16]), h[:4].decode("latin-1"))
            n = struct.unpack_from("<Q", h, 16)[0]
            if n < 24:
                raise BadHeader("a chunk is shorter than its header")
            found.setdefault(name, (at + 24, n - 24))
            at += n + -n % 8
        return "<", found
    if head[:4] not in (b"RIFF", b"RIFX", b"RF64", b"BW64") or head[8:12] != b"WAVE":
        raise BadHeader("not a WAV file")
    order, at, long = ">" if head[:4] == b"RIFX" else "<", 12, {}
    while at + 8 <= size:
        h = read(at, 8)
        name, n = h[:4].decode("latin-1"), struct.unpack(f"{order}I", h[4:])[0]
        if name == "ds64":
            riff, data = _unpack("<QQ", read(at + 8, 16))
            long = {"data": data}
        elif n == 0xFFFFFFFF and name in long:
            n = long[name]
        found.setdefault(name, (at + 8, n))
        at += 8 + n + n % 2
    return order, found


def wav(read: Read, size: int, name: str) -> Recording:
    order, found = _chunks(read, size)
    if "fmt " not in found or "data" not in found:
        raise BadHeader("a format or data chunk is missing")
    at, n = found["fmt "]
    body = read(at, min(n, 64))
    tag, channels, rate, _, align, bits = _unpack(f"{order}HHIIHH", body)
    if tag == EXTENSIBLE:
        if len(body) < 26:
            raise BadHeader("the extended format chunk ends early")
        tag = struct.unpack_from(f"{order}H", body, 24)[0]
    if tag not in (PCM, IEEE_FLOAT):
        raise BadHeader(f"samples of format {tag:#x} are compressed")
    if channels not in (1, 2) or align != channels * bits // 8:
        raise BadHeader(f"{channels} channels of {bits} bits in blocks of {align} bytes")
    kind = "f" if tag == IEEE_FLOAT else "u" if bits == 8 else "i"
    end = "" if bits == 8 else "_be" if order == ">" else "_le"
    datatype = f"{'c' if channels == 2 else 'r'}{kind}{bits}{end}"
    formats.parse(datatype)
    start, stated = found["data"]
    count, warnings = clamp(start, stated, size, "the data chunk")
    frequency = None
    if "auxi" in found:  # two times of 16 bytes, then the centre frequency
        extra = read(found["auxi"][0], min(found["auxi"][1], 64))
        if len(extra) >= 36:
            frequency = float(struct.unpack_from("<I", extra, 32)[0]) or None
    return Recording("WAV", name, datatype, [(start, count - count % align)], float(rate) or None, frequency, channels, warnings=warnings)


# Others


def npy(read: Read, size: int, name: str) -> Recording:
    head = read(0, 12)
    if head[:6] != b"\x93NUMPY":
        raise BadHeader("not an array file")
    start, n = (10, struct.unpack_from("<H", head, 8)[0]) if head[6] == 1 else (12, _unpack("<I", head[8:])[0])
    if n > 1 << 16:
        raise BadHeader("the array header is too long")
    try:
        about = ast.literal_eval(read(start, n).decode("latin-1"))
        order, shape = about["descr"], about["shape"]
    except (ValueError, SyntaxError, KeyError, TypeError) as e:
        raise BadHeader("the array header can't be read") from e
    if not isinstance(order, str) or len(order) < 3 or order[1] not in "cfiu":
        raise BadHeader(f"arrays of {order!r} are not samples")
    width = int(order[2:]) * 8
    pair = len(shape) == 2 and shape[-1] == 2 and order[1] != "c"
    if len(shape) != 1 and not pair:
        raise BadHeader(f"an array of shape {shape} is not one stream")
    bits = width // 2 if order[1] == "c" else width
    datatype = f"{'c' if order[1] == 'c' or pair else 'r'}{'f' if order[1] == 'c' else order[1]}{bits}" + ("" if bits == 8 else "_be" if order[0] == ">" else "_le")
    kind = formats.parse(datatype)
    count, warnings = clamp(start + n, shape[0] * kind.sample_bytes, size, "the array header")
    if about.get("fortran_order") and pair:
        raise BadHeader("columns one after another are not read")
    return Recording("array", name, datatype, [(start + n, count - count % kind.sample_bytes)], warnings=warnings)


def sdriq(read: Read, size: int, name: str) -> Recording:
    head = read(0, 32)
    rate, frequency, _, bits, _, check = _unpack("<IQQIII", head)
    if bits not in (16, 24):
        raise BadHeader(f"samples of {bits} bits")
    warnings = [] if zlib.crc32(head[:28]) == check else ["the header's check sum is wrong: what it says is only a hypothesis"]
    datatype = "ci16_le" if bits == 16 else "ci32_le"  # 24 bits are kept in 32
    width = formats.parse(datatype).sample_bytes
    return Recording("sdriq", name, datatype, [(32, (size - 32) // width * width)], float(rate) or None, float(frequency) or None, warnings=warnings)


#: Component letters of the format and their datatypes.
BLUE = {"B": "i8", "I": "i16", "L": "i32", "F": "f32", "D": "f64"}


def blue(read: Read, size: int, name: str) -> Recording:
    head = read(0, 512)
    if head[:4] != b"BLUE" or len(head) < 512:
        raise BadHeader("not a type 1000 file")
    order = ">" if head[4:8] == b"IEEE" else "<"
    detached = struct.unpack_from(f"{order}i", head, 12)[0]
    start, count = struct.unpack_from(f"{order}dd", head, 32)
    kind, form = struct.unpack_from(f"{order}i", head, 48)[0], head[52:54].decode("latin-1")
    if kind // 1000 != 1:
        raise BadHeader(f"files of type {kind} are not streams")
    if form[0] not in "SC" or form[1] not in BLUE:
        raise BadHeader(f"components of format {form!r}")
    end = "" if form[1] == "B" else "_be" if head[8:12] == b"IEEE" else "_le"
    datatype = ("c" if form[0] == "C" else "r") + BLUE[form[1]] + end
    step = struct.unpack_from(f"{order}d", head, 264)[0]
    warnings: list[str] = []
    if detached:
        return Recording("Blue", name, datatype, [(int(start), int(count))], 1 / step if step > 0 else None, file=name.rsplit(".", 1)[0] + ".det")
    there, warnings = clamp(int(start), int(count), size, "the header")
    width = formats.parse(datatype).sample_bytes
    return Recording("Blue", name, datatype, [(int(start), there - there % width)], 1 / step if step > 0 else None, warnings=warnings)


def vita49(read: Read, size: int, name: str, block: int = 1 << 20) -> Recording:
    """Data packets become segments, context packets tell rate, frequency and format. The file is walked by packet headers."""
    segments, rate, frequency, datatype, warnings, at = [], None, None, None, [], 0
    held, base = b"", 0

    def look(offset: int, n: int) -> bytes:
        nonlocal held, base
        if not base <= offset <= offset + n <= base + len(held):
            held, base = read(offset, max(block, n)), offset
        return held[offset - base : offset - base + n]

    while at + 4 <= size:
        word = struct.unpack(">I", look(at, 4))[0]
        kind, length = word >> 28, (word & 0xFFFF) * 4
        if length < 4 or at + length > size:
            warnings.append(f"the packet at {at} is cut off")
            break
        skip = 4 + (4 if kind in (1, 3, 4, 5) else 0) + (8 if word >> 27 & 1 else 0) + (4 if word >> 22 & 3 else 0) + (8 if word >> 20 & 3 else 0)
        if kind in (0, 1):
            trailer = 4 if word >> 26 & 1 else 0
            if skip + trailer > length:
                raise BadHeader(f"the packet at {at} has no payload")
            segments.append((at + skip, length - skip - trailer))
        elif kind == 4:
            body = look(at, length)
            fields, p = struct.unpack_from(">I", body, skip)[0], skip + 4
            for bit, width in ((30, 4), (29, 8), (28, 8), (27, 8), (26, 8), (25, 4), (24, 4), (23, 4), (22, 4), (21, 8), (20, 8), (19, 4), (18, 4), (17, 8), (16, 4), (15, 8)):
                if not fields >> bit & 1 or p + width > length:
                    continue
                if bit == 27:
                    frequency = struct.unpack_from(">q", body, p)[0] / 2**20
                elif bit == 21:
                    rate = struct.unpack_from(">q", body, p)[0] / 2**20
                elif bit == 15:
                    form = struct.unpack_from(">I", body, p)[0]
                    layout, item, bits = form >> 29 & 3, form >> 24 & 31, (form & 63) + 1
                    name_of = ("f" if item in (14, 15) else "i" if item == 0 else "u" if item == 16 else "") + str(bits)
                    datatype = ("c" if layout == 1 else "r") + name_of + ("" if bits == 8 else "_be")
                p += width
        at += length
    if not any(n for _, n in segments):
        raise BadHeader("no data packet")
    if datatype is not None:
        try:
            formats.parse(datatype)
        except ValueError:
            datatype = None
            warnings.append("the payload format is not one that can be read")
    return Recording("VITA 49", name, datatype, segments, rate, frequency, warnings=warnings)


def kind_of(head: bytes, name: str) -> str:
    """The container by its first bytes, then by its name."""
    low = name.lower()
    if low.endswith((".gz", ".zip")):
        return "compressed"
    if low.endswith((".sigmf-meta", ".sigmf-data", ".sigmf")):
        return "SigMF archive" if low.endswith(".sigmf") else "SigMF"
    if head[:4] in (b"RIFF", b"RIFX", b"RF64", b"BW64") or head[:16] == W64["riff"]:
        return "WAV"
    if head[:6] == b"\x93NUMPY":
        return "array"
    if head[:4] == b"BLUE":
        return "Blue"
    if low.endswith(".sdriq"):
        return "sdriq"
    if low.endswith((".vrt", ".vita49", ".vita")):
        return "VITA 49"
    return "raw"
