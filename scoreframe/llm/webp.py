"""Lossless WebP: a decoder of the whole VP8L format and an encoder of RGB pictures.

The decoder reads simple and normal prefix codes by tables, meta prefix codes, back-references and the colour cache, and
inverts the predictor, cross-colour, subtract-green and palette transforms (with bundled pixels). The encoder estimates what
each transform would save and takes the best one, finds back-references, tries a colour cache, and writes prefix codes of
the symbols that occur. Both work on many pictures together, so that numpy's calls are shared. Equal pictures, equal bytes.
"""

from __future__ import annotations

import functools
import struct

import numpy as np

#: Fixed values of the format.
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_LENGTH_PLACES = np.array(_LENGTH_ORDER)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Short distance codes: offsets (left, up) in order of distance.
_NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda v: (v[0] ** 2 + v[1] ** 2, abs(v[0]), -v[0]))
SIDE, LONGEST_COPY, OPAQUE = 16384, 4096, 255 << 24
_CACHE = 0x1E35A7BD
_SPREAD = 0x9E3779B97F4A7C15
#: What the encoder tries and keeps to: colour cache bits, widest code, shortest copy.
CACHE_BITS, WIDEST, SHORTEST_COPY = 7, 11, 3
#: Parts of a bit in estimates; sections of an image in a stream: cache bits, two for each of five codes, pixels.
BIT, IMAGE_SECTIONS = 1024, 12
#: Images that are rather read one by one than together.
FEW = 16
#: Back-references of one step that are rather read one by one than together.
FEW_COPIES = 4
_PLACES = np.array([0, 256, 512])


@functools.lru_cache(16)
def _reversed_bits(n: int) -> np.ndarray:
    """The numbers of n bits, read backwards."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


class Bits:
    """Reads bits, the least significant of each byte first."""

    def __init__(self, data: bytes):
        self.data = data + b"\0" * 16
        self.at, self.size = 0, 8 * len(data)

    def peek(self, at: int) -> int:
        """The bits from ``at`` on, 57 or more while the stream lasts."""
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7)

    def words(self, first: int, many: int) -> np.ndarray:
        """The 56 bits from each of some bytes on."""
        d = np.frombuffer(self.data, np.uint8)[first : first + many + 7]
        if len(d) < 8:
            return np.zeros(0, np.int64)
        whole = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(d, 8)).view("<u8").reshape(-1)
        return (whole & np.uint64((1 << 56) - 1)).astype(np.int64)

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > self.size:
            raise ValueError("the stream ends early")
        return self.peek(at) & ((1 << n) - 1)


class Code:
    """A canonical prefix code given by its lengths, as a table by the next ``width`` bits of symbol << 4 | length."""

    def __init__(self, lengths: np.ndarray):
        used = lengths.nonzero()[0]
        if len(used) < 2:
            self.entries = np.array([used[0] << 4 if len(used) else 0])
        else:
            n = lengths[used]
            order = n.astype(np.uint8).argsort(kind="stable")
            n = n[order]
            width = int(n[-1])
            entries = (used[order] << 4 | n).astype(np.int32).repeat(1 << (width - n))
            if len(entries) != 1 << width:
                raise ValueError("an incomplete prefix code")
            self.entries = entries[_reversed_bits(width)]
        self.mask = len(self.entries) - 1

    @functools.cached_property
    def table(self) -> list[int]:
        return self.entries.tolist()

    def read(self, bits: Bits) -> int:
        entry = self.table[bits.peek(bits.at) & self.mask]
        bits.at += entry & 15
        if bits.at > bits.size:
            raise ValueError("the stream ends early")
        return entry >> 4

    def moved(self, by: int) -> list[int]:
        """The table with symbols further left by some bits."""
        entries = self.entries.astype(np.int64)
        return (entries >> 4 << (4 + by) | entries & 15).tolist() if by else self.table


@functools.lru_cache(4096)
def _simple_code(size: int, *symbols: int) -> Code:
    lengths = np.zeros(size, np.int64)
    lengths[list(symbols)] = 1
    return Code(lengths)


def _read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)]
        if two:
            symbols.append(bits.read(8))
        if max(symbols) >= size:
            raise ValueError("the code lengths don't fit")
        return _simple_code(size, *symbols)
    many = 4 + bits.read(4)
    told = bits.peek(bits.at)
    bits.at += 3 * many
    of_lengths = np.zeros(19, np.int64)
    of_lengths[_LENGTH_PLACES[:many]] = [told >> 3 * i & 7 for i in range(many)]
    code = Code(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    out: list[int] = []
    previous, at, table, mask = 8, bits.at, code.table, code.mask
    now, far = 0, at - 1
    while len(out) < size and left and at <= bits.size:
        left -= 1
        if at > far:  # a stretch of bits that holds many lengths
            now, far = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 40], "little") >> (at & 7), at + 296
        entry = table[now & mask]
        n, used = entry >> 4, entry & 15
        if n < 16:
            out.append(n)
            previous = n or previous
        elif n == 16:
            out += [previous] * (3 + (now >> used & 3))
            used += 2
        elif n == 17:
            out += [0] * (3 + (now >> used & 7))
            used += 3
        else:
            out += [0] * (11 + (now >> used & 127))
            used += 7
        now >>= used
        at += used
    bits.at = at
    if len(out) > size or at > bits.size:
        raise ValueError("the code lengths don't fit")
    return Code(np.array(out, np.int64))


def _extended(bits: Bits, prefix: int) -> int:
    """The value of a length or distance prefix."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


_NEAR_PLACES = np.array(_NEAR)


def _extended_all(prefix: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, bits that they take) of length or distance prefixes, given the bits after each."""
    extra = np.maximum(prefix - 2, 0) >> 1
    return np.where(prefix < 4, prefix, (2 + (prefix & 1) << extra) + (now & (1 << extra) - 1)) + 1, extra


class Image:
    """An image whose codes were read and whose pixels, ARGB values one row after the other, are still to be read."""

    def __init__(self, bits: Bits, width: int, height: int, top: bool):
        self.bits, self.width, self.total = bits, width, width * height
        self.cache_bits = bits.read(4) if bits.read(1) else 0
        self.meta, self.meta_bits, groups, self.across = None, 0, 1, 0
        if top and bits.read(1):
            self.meta_bits = bits.read(3) + 2
            self.across = -(-width >> self.meta_bits)
            self.meta = (_one_by_one(Image(bits, self.across, -(-height >> self.meta_bits), False)) >> 8 & 0xFFFF).tolist()
            groups = max(self.meta) + 1
        sizes = (256 + 24 + (1 << self.cache_bits if self.cache_bits else 0), 256, 256, 256, 40)
        self.codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
        self.found: list[int] = []

    def read_copy(self, symbol: int, distance: Code) -> tuple[int, int]:
        """(length, how far back) of a back-reference whose length symbol was read."""
        length, near = _extended(self.bits, symbol - 256), _extended(self.bits, distance.read(self.bits))
        if near > len(_NEAR):
            return length, near - len(_NEAR)
        x, y = _NEAR[near - 1]
        return length, max(1, x + y * self.width)


def _one_by_one(image: Image) -> np.ndarray:
    """An image's pixels, after those that were found before."""
    bits, width, total, meta, codes = image.bits, image.width, image.total, image.meta, image.codes
    tables = [[c.moved(by) for c, by in zip(group, (8, 16, 0, 24), strict=False)] for group in codes]  # where pixels have them
    start = bits.at >> 3 << 3
    words, at = bits.words(start >> 3, len(bits.data)).tolist(), bits.at - start
    cache, cached, shift = [0] * (1 << image.cache_bits), 0, 32 - image.cache_bits
    i, stop = len(image.found), 0
    out = image.found + [0] * (total - i)
    try:
        while i < total:
            if i >= stop:  # the group of codes changes
                whose = meta[(i // width >> image.meta_bits) * image.across + (i % width >> image.meta_bits)] if meta else 0
                column = i % width
                stop = i - column + min(width, (column >> image.meta_bits) + 1 << image.meta_bits) if meta else total
                (g, r, b, a), (g_mask, r_mask, b_mask, a_mask) = tables[whose], [c.mask for c in codes[whose][:4]]
                opaque, distance = a[0] >> 4, codes[whose][4]
            now = words[at >> 3] >> (at & 7)
            entry = g[now & g_mask]
            n = entry & 15
            if entry < 1 << 20:  # green is a value below 256
                e1 = r[now >> n & r_mask]
                n += e1 & 15
                e2 = b[now >> n & b_mask]
                at += n + (e2 & 15)
                if a_mask:
                    e3 = a[words[at >> 3] >> (at & 7) & a_mask]
                    at += e3 & 15
                    opaque = e3 >> 4
                out[i] = (entry | e1 | e2) >> 4 | opaque
                i += 1
                continue
            symbol = entry >> 12
            if symbol >= 280:
                at += n
                while cached < i:  # entries are made when they are next needed
                    p = out[cached]
                    cache[(_CACHE * p & 0xFFFFFFFF) >> shift] = p
                    cached += 1
                out[i] = cache[symbol - 280]
                i += 1
            else:
                bits.at = start + at + n
                length, back = image.read_copy(symbol, distance)
                at = bits.at - start
                if back > i or i + length > total:
                    raise ValueError("a back-reference leaves the image")
                if back >= length:
                    out[i : i + length] = out[i - back : i - back + length]
                else:
                    out[i : i + length] = (out[i - back : i] * (length // back + 1))[:length]
                i += length
    except IndexError:
        raise ValueError("the stream ends early") from None
    bits.at = start + at
    if bits.at > bits.size:
        raise ValueError("the stream ends early")
    return np.array(out, np.int64)


def _together(images: list[Image]) -> list[np.ndarray]:
    """The pixels of many images: one number of each image in turn, while more than ``FEW`` of them go on, so that numpy's
    calls are shared. Images with several groups of codes or a code of alphas are read one by one."""
    even = [k for k, image in enumerate(images) if len(image.codes) == 1 and not image.codes[0][3].mask]
    if len(even) > FEW:
        ours = [images[k] for k in even]
        codes = [image.codes[0] for image in ours]
        tables, begins, masks = [], [], []
        for k, by in ((0, 8), (1, 16), (2, 0), (4, 0)):
            entries = [c[k].entries for c in codes]
            sizes = np.array([len(e) for e in entries])
            joined = np.concatenate(entries).astype(np.int64)
            tables.append(joined >> 4 << (4 + by) | joined & 15)
            begins.append(np.cumsum(sizes) - sizes)
            masks.append(sizes - 1)
        streams = [image.bits.words(0, len(image.bits.data)) for image in ours]
        sizes = np.array([len(w) for w in streams])
        words = np.concatenate([*streams, np.zeros(8, np.int64)])
        stream_at = 8 * (np.cumsum(sizes) - sizes)
        sizes = np.array([image.total for image in ours])
        end = np.cumsum(sizes)
        begin = end - sizes
        out = np.zeros(int(end[-1]), np.int64)
        slots = 1 << np.array([image.cache_bits for image in ours])
        cache = np.zeros(int(slots.sum()), np.int64)
        shift = 32 - np.array([image.cache_bits for image in ours])
        opaque = np.array([int(c[3].entries[0]) >> 4 << 24 for c in codes])
        (g, r, b, d), lane = tables, np.arange(len(ours))
        at, pos = stream_at + np.array([image.bits.at for image in ours]), begin.copy()
        state = [lane, at, pos, end, *begins, *masks, np.cumsum(slots) - slots, shift, opaque, begin, np.array([image.width for image in ours])]
        last_at, last_pos = at.copy(), pos.copy()
        while len(lane) > FEW:
            lane, at, pos, until, g_at, r_at, b_at, d_at, g_mask, r_mask, b_mask, d_mask, c_at, shift, opaque, first, wide = state
            for _ in range(int((until - pos).min())):
                try:
                    now = words[at >> 3] >> (at & 7)
                except IndexError:
                    raise ValueError("the stream ends early") from None
                entry = g[g_at + (now & g_mask)]
                n = entry & 15
                e1 = r[r_at + (now >> n & r_mask)]
                n += e1 & 15
                e2 = b[b_at + (now >> n & b_mask)]
                n += e2 & 15
                pixel = (entry | e1 | e2) >> 4 | opaque
                other = (entry >= 1 << 20).nonzero()[0]
                copies = other
                if len(other):
                    symbol = entry[other] >> 12
                    hit = symbol >= 280
                    cached = other[hit]
                    pixel[cached] = cache[c_at[cached] + symbol[hit] - 280]
                    n[cached] = entry[cached] & 15
                    copies = other[~hit]
                    for k in copies.tolist() if len(copies) <= FEW_COPIES else ():
                        image, mine, p = ours[lane[k]], int(stream_at[lane[k]]), int(pos[k])
                        image.bits.at = int(at[k]) - mine + int(entry[k] & 15)
                        length, back = image.read_copy(int(entry[k]) >> 12, codes[lane[k]][4])
                        if back > p - begin[lane[k]] or p + length > until[k]:
                            raise ValueError("a back-reference leaves the image")
                        added = np.resize(out[p - back : p], length) if back < length else out[p - back : p - back + length]
                        out[p : p + length] = added
                        cache[c_at[k] + ((_CACHE * added & 0xFFFFFFFF) >> shift[k])] = added  # of one slot the last stays
                        pixel[k], n[k] = added[-1], image.bits.at + mine - at[k]
                        pos[k] += length - 1
                    if len(copies) > FEW_COPIES:
                        there, start = at[copies] + (entry[copies] & 15), pos[copies]
                        try:
                            length, used = _extended_all((entry[copies] >> 12) - 256, words[there >> 3] >> (there & 7))
                            there += used
                            now = words[there >> 3] >> (there & 7)
                        except IndexError:
                            raise ValueError("the stream ends early") from None
                        e4 = d[d_at[copies] + (now & d_mask[copies])]
                        near, used = _extended_all(e4 >> 4, now >> (e4 & 15))
                        there += used + (e4 & 15)
                        place = _NEAR_PLACES[np.minimum(near, len(_NEAR)) - 1]
                        back = np.where(near > len(_NEAR), near - len(_NEAR), np.maximum(1, place[:, 0] + place[:, 1] * wide[copies]))
                        if (back > start - first[copies]).any() or (start + length > until[copies]).any():
                            raise ValueError("a back-reference leaves the image")
                        end_of = np.cumsum(length)
                        of = np.repeat(np.arange(len(copies)), length)
                        step = np.arange(int(end_of[-1])) - (end_of - length)[of]
                        added = out[(start - back)[of] + step % back[of]]
                        out[start[of] + step] = added
                        cache[c_at[copies][of] + ((_CACHE * added & 0xFFFFFFFF) >> shift[copies][of])] = added
                        pixel[copies], n[copies] = added[end_of - 1], there - at[copies]
                        pos[copies] += length - 1
                out[pos] = pixel
                cache[c_at + ((_CACHE * pixel & 0xFFFFFFFF) >> shift)] = pixel
                pos += 1
                at += n
                if len(copies):
                    break
            last_at[lane], last_pos[lane] = at, pos
            going = pos < until
            if not going.all():
                state = [v[going] for v in state]
                lane = state[0]
        for k, image in enumerate(ours):
            image.bits.at = int(last_at[k] - stream_at[k])
            if image.bits.at > image.bits.size:
                raise ValueError("the stream ends early")
            image.found = out[begin[k] : last_pos[k]]
        for k in lane.tolist():
            ours[k].found = ours[k].found.tolist()
    return [image.found if len(image.found) == image.total else _one_by_one(image) for image in images]


def _channels(pixels: np.ndarray) -> np.ndarray:
    return np.stack([pixels >> s & 255 for s in (24, 16, 8, 0)], axis=-1)


def _joined(channels: np.ndarray) -> np.ndarray:
    a, r, g, b = (channels[..., k] & 255 for k in range(4))
    return a << 24 | r << 16 | g << 8 | b


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def _half(v: int) -> int:
    """Half of v, towards zero."""
    return v // 2 if v >= 0 else -(-v // 2)


def predict(mode: int, left, up, corner, right) -> list[int]:
    """The predicted channels from the left, upper, upper left and upper right pixels' channels."""
    if mode == 11:
        to_left, to_up = sum(abs(u - c) for u, c in zip(up, corner, strict=True)), sum(abs(v - c) for v, c in zip(left, corner, strict=True))
        return left if to_left < to_up else up
    one = {
        1: lambda v, u, c, r: v, 2: lambda v, u, c, r: u, 3: lambda v, u, c, r: r, 4: lambda v, u, c, r: c,
        5: lambda v, u, c, r: ((v + r) // 2 + u) // 2, 6: lambda v, u, c, r: (v + c) // 2, 7: lambda v, u, c, r: (v + u) // 2,
        8: lambda v, u, c, r: (c + u) // 2, 9: lambda v, u, c, r: (u + r) // 2, 10: lambda v, u, c, r: ((v + c) // 2 + (u + r) // 2) // 2,
        12: lambda v, u, c, r: _clamp(v + u - c), 13: lambda v, u, c, r: _clamp((v + u) // 2 + _half((v + u) // 2 - c)),
    }.get(mode)
    return [one(*n) for n in zip(left, up, corner, right, strict=True)] if one else [255, 0, 0, 0]


def _undo_predictor(pixels: np.ndarray, width: int, height: int, bits: int, data: np.ndarray) -> np.ndarray:
    """Row by row. Modes that look at the row above, or only at the left pixel, take a tile's stretch of a row at once."""
    image = _channels(pixels).reshape(height, width, 4)
    modes = (data >> 8 & 15).reshape(-(-height >> bits), -1)
    image[0, 0, 0] += 255
    image[0] = np.cumsum(image[0], axis=0) & 255
    for y in range(1, height):
        row, above = image[y], image[y - 1]
        row[0] = (row[0] + above[0]) & 255
        further = np.concatenate([above[1:], row[:1]])  # upper right; the row's own first pixel at its end
        for tile, mode in enumerate(modes[y >> bits].tolist()):
            x0, x1 = max(1, tile << bits), min(width, (tile + 1) << bits)
            if x0 >= x1:
                continue
            u, c, r = above[x0:x1], above[x0 - 1 : x1 - 1], further[x0:x1]
            if mode == 1:
                row[x0:x1] = (row[x0 - 1] + np.cumsum(row[x0:x1], axis=0)) & 255
            elif mode in (0, 2, 3, 4, 8, 9, 14, 15):
                guess = {2: u, 3: r, 4: c, 8: (c + u) >> 1, 9: (u + r) >> 1}.get(mode, np.array([255, 0, 0, 0]))
                row[x0:x1] = (row[x0:x1] + guess) & 255
            else:
                left, done = row[x0 - 1].tolist(), []
                for rest, up, corner, right in zip(row[x0:x1].tolist(), u.tolist(), c.tolist(), r.tolist(), strict=True):
                    left = [(v + p) & 255 for v, p in zip(rest, predict(mode, left, up, corner, right), strict=True)]
                    done.append(left)
                row[x0:x1] = done
    return _joined(image).reshape(-1)


def _signed(v):
    return v - ((v & 128) << 1)


def _cross(pixels: np.ndarray, to_red, to_blue, red_to_blue, sign: int) -> np.ndarray:
    """Red and blue with the shares of green (and of red) added, or taken away where sign is -1."""
    a, red, green, blue = (pixels >> s & 255 for s in (24, 16, 8, 0))
    other = (red + sign * (_signed(to_red) * _signed(green) >> 5)) & 255
    whole = other if sign > 0 else red
    blue = (blue + sign * ((_signed(to_blue) * _signed(green) >> 5) + (_signed(red_to_blue) * _signed(whole) >> 5))) & 255
    return a << 24 | other << 16 | green << 8 | blue


def _undo_cross_colour(pixels: np.ndarray, width: int, height: int, bits: int, data: np.ndarray) -> np.ndarray:
    tile = data.reshape(-(-height >> bits), -1)[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits].reshape(-1)
    return _cross(pixels, tile & 255, tile >> 8 & 255, tile >> 16 & 255, 1)


def _stream_of(stored: bytes) -> bytes:
    """The VP8L stream of a simple or extended file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(stored):
        size = struct.unpack("<I", stored[at + 4 : at + 8])[0]
        if stored[at : at + 4] == b"VP8L":
            if size < 5 or stored[at + 8] != 0x2F:
                break
            return stored[at + 9 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("not a lossless WebP file")


def size_of(stored: bytes) -> tuple[int, int]:
    """A file's width and height."""
    bits = Bits(_stream_of(stored))
    return bits.read(14) + 1, bits.read(14) + 1


def _begun(stored: bytes) -> tuple[Image, int, int, list[tuple]]:
    """A file's image before its pixels are read, its width and height, and its transforms."""
    bits = Bits(_stream_of(stored))
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, across = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            data = _one_by_one(Image(bits, -(-across >> size), -(-height >> size), False))
            undo.append((kind, across, size, data))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, across, 0, None))
        else:
            size = bits.read(8) + 1
            table = _joined(np.cumsum(_channels(_one_by_one(Image(bits, size, 1, False))), axis=0))
            packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((kind, across, packed, np.concatenate([table, np.zeros(256 - size, np.int64)])))
            across = -(-across >> packed)
    return Image(bits, across, height, True), width, height, undo


def _undone(pixels: np.ndarray, width: int, height: int, undo: list[tuple]) -> np.ndarray:
    """The image as an array of height, width and ARGB channels, its transforms inverted."""
    for kind, wide, size, data in reversed(undo):
        if kind == PREDICTOR:
            pixels = _undo_predictor(pixels, wide, height, size, data)
        elif kind == CROSS_COLOUR:
            pixels = _undo_cross_colour(pixels, wide, height, size, data)
        elif kind == SUBTRACT_GREEN:
            c = _channels(pixels)
            c[:, 1] += c[:, 2]
            c[:, 3] += c[:, 2]
            pixels = _joined(c)
        else:
            index = pixels >> 8 & 255
            if size:
                each = 8 >> size
                index = (index.reshape(height, -1, 1) >> np.arange(0, 8, each) & ((1 << each) - 1)).reshape(height, -1)[:, :wide].reshape(-1)
            pixels = data[index]
    return pixels.astype("<u4").view(np.uint8).reshape(height, width, 4)[..., ::-1]


def decode_all(files: list[bytes]) -> list[np.ndarray]:
    """Each file's image as an array of height, width and ARGB channels."""
    begun = [_begun(f) for f in files]
    pixels = _together([b[0] for b in begun])
    return [_undone(p, *b[1:]) for p, b in zip(pixels, begun, strict=True)]


def decode(stored: bytes) -> np.ndarray:
    """One file's image."""
    return decode_all([stored])[0]


# --- encoding


def wrap(stream: bytes) -> bytes:
    """The file around a VP8L stream."""
    body = b"\x2f" + stream
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def _packed(values: np.ndarray, widths: np.ndarray, stream: np.ndarray, streams: int) -> list[bytes]:
    """The bytes of every stream, whose numbers of at most 56 bits stand one after the other, the streams in order."""
    size = (np.bincount(stream, widths, streams).astype(np.int64) + 7) >> 3
    end = np.cumsum(size)
    before = np.cumsum(widths) - widths
    first = np.searchsorted(stream, np.arange(streams))
    begin = np.append(before, widths.sum())[first]  # in bits, without what fills the bytes before
    at = before + (8 * (end - size) - begin)[stream]
    shifted, byte = values << (at & 7), at >> 3
    over = (int(widths.max(initial=1)) + 14) >> 3  # bytes that a number lies in
    out = sum(np.bincount(byte + k, shifted >> 8 * k & 255, int(size.sum()) + over) for k in range(over))
    whole = out.astype(np.uint8).tobytes()
    return [whole[e - n : e] for e, n in zip(end.tolist(), size.tolist(), strict=True)]


class Streams:
    """Collects the numbers of many streams, each in numbered sections, and how many bits each number takes."""

    def __init__(self, streams: int, sections: int):
        self.streams, self.sections = streams, sections
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def put(self, section: int, stream: np.ndarray, values: np.ndarray, widths: np.ndarray) -> None:
        """A row of numbers for each entry of ``stream``, which ascends."""
        shape = np.broadcast_shapes(values.shape, widths.shape)
        where = np.broadcast_to((stream * self.sections + section)[:, None], shape)
        used = np.broadcast_to(widths, shape) > 0
        self.parts.append((where[used], np.broadcast_to(values, shape)[used], np.broadcast_to(widths, shape)[used]))

    def bytes(self) -> list[bytes]:
        where, values, widths = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        order = np.argsort(where.astype(np.min_scalar_type(self.streams * self.sections)), kind="stable")
        return _packed(values[order], widths[order], where[order] // self.sections, self.streams)


class Writer:
    """Collects the numbers of one stream and how many bits each takes."""

    def __init__(self):
        self.held: list[tuple[int, int]] = []

    def put(self, value: int, width: int) -> None:
        self.held.append((value, width))

    def bytes(self) -> bytes:
        all_ = np.array(self.held, np.int64).reshape(-1, 2)
        return _packed(all_[:, 0], all_[:, 1], np.zeros(len(all_), np.int64), 1)[0]


def _depths(counts: list[int]) -> list[int]:
    """The depths of a Huffman tree's leaves, for two or more counts in ascending order."""
    n = len(counts)
    weight, parent = list(counts), [0] * (2 * n - 1)
    leaf, node = 0, n
    for k in range(n, 2 * n - 1):
        total = 0
        for _ in (0, 1):
            if node >= k or (leaf < n and weight[leaf] <= weight[node]):
                at, leaf = leaf, leaf + 1
            else:
                at, node = node, node + 1
            total += weight[at]
            parent[at] = k
        weight.append(total)
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    return depth[:n]


def _lengths_of(counts: np.ndarray, widest: int = WIDEST) -> np.ndarray:
    """For each row of counts, the lengths of a prefix code for the symbols that occur, none over ``widest``: rare ones are
    taken as more frequent. A single symbol has length 1."""
    rows, symbols = np.nonzero(counts)
    seen = counts[rows, symbols]
    order = np.lexsort((seen, rows))
    symbols, seen = symbols[order], seen[order].tolist()
    depths, at = [], 0
    for n in np.bincount(rows, minlength=len(counts)).tolist():
        if n > 1:
            now, least = seen[at : at + n], 1
            while (found := _depths(now))[0] > widest:  # the rarest is deepest
                least *= 2
                now = [max(least, c) for c in now]
            depths += found
        else:
            depths += [1] * n
        at += n
    lengths = np.zeros(counts.shape, np.int64)
    lengths[rows, symbols] = depths
    return lengths


def code_lengths(counts: np.ndarray, widest: int = WIDEST) -> np.ndarray:
    return _lengths_of(counts[None], widest)[0]


def _codes_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes as they are written, widths) of every symbol, by row; a single symbol takes no bits."""
    rows, symbols = np.nonzero(lengths)
    long = lengths[rows, symbols]
    order = np.lexsort((long, rows))
    rows, symbols, long = rows[order], symbols[order], long[order]
    spread = 1 << (15 - long)
    before = np.cumsum(spread) - spread
    each = np.bincount(rows, minlength=len(lengths))
    first = (np.cumsum(each) - each)[rows]
    codes, widths = np.zeros(lengths.shape, np.int64), np.zeros(lengths.shape, np.int64)
    single = each[rows] < 2
    codes[rows, symbols] = np.where(single, 0, _reversed_bits(15)[before - before[first]])
    widths[rows, symbols] = np.where(single, 0, long)
    return codes, widths


def _code_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, widths = _codes_of(lengths[None])
    return codes[0], widths[0]


def _put_codes(out: Streams, section: int, stream: np.ndarray, lengths: np.ndarray) -> None:
    """Write each row's lengths: simple where one or two symbols below 256 occur, as runs of lengths otherwise. Takes two
    sections."""
    used = lengths > 0
    many, size = used.sum(axis=1), lengths.shape[1]
    low, top = used.argmax(axis=1), size - 1 - used[:, ::-1].argmax(axis=1)
    top = np.where(many > 0, top, 0)
    simple = (many <= 2) & (top < 256)
    one, two, wide = low[simple], top[simple], low[simple] > 1
    pair = many[simple] == 2
    ones = np.ones(len(one), np.int64)
    out.put(section, stream[simple], np.column_stack([ones, pair, wide, one, two]), np.column_stack([ones, ones, ones, np.where(wide, 8, 1), 8 * pair]))
    if simple.all():
        return
    lengths, stream, top = lengths[~simple], stream[~simple], top[~simple]
    code = np.repeat(np.arange(len(top)), top + 1)
    flat = lengths[np.arange(size) <= top[:, None]]
    edge = np.flatnonzero((np.diff(flat, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
    value, times, of = flat[edge], np.diff(np.append(edge, len(flat))), code[edge]
    # a run is the length itself, whole repeats, a last one, and the few that are left; lone codes get a zero more
    zero = value == 0
    whole, rest = np.divmod(np.where(zero, times, times - 1), np.where(zero, 138, 6))
    last = rest >= 3
    eleven = rest >= 11
    lone = np.bincount(of, np.where(zero, 0, 1) + whole + np.where(last, 1, rest), len(top))[of] < 2
    kinds = np.column_stack([value, np.where(zero, 18, 16), np.where(zero, np.where(eleven, 18, 17), 16), value, np.zeros_like(value)])
    extra = np.column_stack([np.zeros_like(value), np.where(zero, 127, 3), np.where(zero & eleven, rest - 11, rest - 3), *[np.zeros_like(value)] * 2])
    bits = np.column_stack([np.zeros_like(value), np.where(zero, 7, 2), np.where(zero, np.where(eleven, 7, 3), 2), *[np.zeros_like(value)] * 2])
    number = np.column_stack([~zero, whole, last, np.where(last, 0, rest), lone]).reshape(-1)
    kinds, extra, bits = (np.repeat(v.reshape(-1), number) for v in (kinds, extra, bits))
    of = np.repeat(np.repeat(of, 5), number)
    short = _lengths_of(np.bincount(of * 19 + kinds, minlength=19 * len(top)).reshape(-1, 19), 7)
    codes, widths = _codes_of(short)
    shown = short[:, list(_LENGTH_ORDER)]
    many = np.maximum(4, 19 - (shown[:, ::-1] > 0).argmax(axis=1))
    tokens = np.bincount(of, minlength=len(top)) - 2
    size = np.maximum(0, (np.frexp(tokens.astype(np.float64))[1] - 1) // 2)
    ones = np.ones(len(top), np.int64)
    out.put(
        section,
        stream,
        np.column_stack([0 * ones, many - 4, shown, ones, size, tokens]),
        np.column_stack([ones, 4 * ones, np.where(np.arange(19) < many[:, None], 3, 0), ones, 3 * ones, 2 + 2 * size]),
    )
    out.put(section + 1, stream[of], np.column_stack([codes[of, kinds], extra]), np.column_stack([widths[of, kinds], bits]))


def _put_code(out: Writer, lengths: np.ndarray) -> None:
    """One code for one stream."""
    streams = Streams(1, 2)
    _put_codes(streams, 0, np.zeros(1, np.int64), lengths[None])
    for _, values, widths in streams.parts:
        out.held += zip(values.tolist(), widths.tolist(), strict=True)


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, extra, width of extra) of lengths or distances."""
    v = values - 1
    high = np.maximum(1, np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1)
    width = np.where(v < 4, 0, high - 1)
    prefix = np.where(v < 4, v, 2 * high + (v >> np.maximum(0, high - 1) & 1))
    return prefix, v & ((1 << width) - 1), width


@functools.lru_cache(512)
def _near_codes(width: int) -> np.ndarray:
    """The short code of every distance below eight rows, 0 where there is none."""
    out = np.zeros(8 * width + 16, np.int64)
    for k in range(len(_NEAR), 0, -1):
        x, y = _NEAR[k - 1]
        out[max(1, x + y * width)] = k
    return out


def _copies(pixels: np.ndarray, image: np.ndarray, images: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, distance) of the stretches that are copied from the last place in their image with the same few pixels."""
    none = np.zeros(0, np.int64)
    n = len(pixels) - SHORTEST_COPY + 1
    if n < 2:
        return none, none, none
    mixed = pixels.astype(np.uint64) * np.uint64(_SPREAD)
    key = mixed[:n].copy()
    for k in range(1, SHORTEST_COPY):
        key = (key >> np.uint64(29) ^ key) * np.uint64(_SPREAD) + mixed[k : n + k]
    inside = np.flatnonzero(image[:n] == image[SHORTEST_COPY - 1 :])
    key = key[inside] >> np.uint64(16) | image[inside].astype(np.uint64) << np.uint64(48)
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(again):
        return none, none, none
    back = np.zeros(n, np.int64)
    place = inside[order]
    back[place[again + 1]] = place[again + 1] - place[again]
    edge = np.flatnonzero(np.diff(back, prepend=-1))
    span = np.diff(np.append(edge, n))
    until = np.repeat(edge + span + SHORTEST_COPY - 1, span)  # all of a stretch with one distance is copied together
    starts, stop = [], 0
    found = np.flatnonzero(back)
    for at, end in zip(found.tolist(), until[found].tolist(), strict=True):
        while at >= stop and end - at >= SHORTEST_COPY:
            starts.append(at)  # more than the longest copy goes on at the same distance
            at = stop = min(end, at + LONGEST_COPY)
    start = np.array(starts, np.int64)
    length, distance = np.minimum(until[start] - start, LONGEST_COPY), back[start]
    at = np.arange(int(length.sum())) + np.repeat(start - np.cumsum(length) + length, length)
    wrong = pixels[at] != pixels[at - np.repeat(distance, length)]
    if wrong.any():  # two stretches of one hash that differ: their images get no copies
        right = ~np.isin(image[start], image[at[wrong]])
        start, length, distance = start[right], length[right], distance[right]
    return start, length, distance


@functools.lru_cache(1)
def _logs() -> np.ndarray:
    n = np.arange(1 << 16, dtype=np.float64)
    return np.rint(n * np.log2(np.maximum(n, 1)) * BIT).astype(np.int64)


def _times_log(n: np.ndarray) -> np.ndarray:
    """n times its logarithm in parts of a bit: whole numbers, whose sums don't depend on what stands beside them."""
    out = _logs()[np.minimum(n, (1 << 16) - 1)]
    large = n >= 1 << 16
    if large.any():
        out[large] = np.rint(n[large] * np.log2(n[large]) * BIT)
    return out


def _entropy(counts: np.ndarray, total: np.ndarray, alphabets: int = 1) -> np.ndarray:
    """The parts of a bit that each row's symbols take together, in alphabets of ``total`` occurrences each."""
    return alphabets * _times_log(total) - _times_log(counts).sum(axis=1)


def _put_images(out: Streams, section: int, stream: np.ndarray, pixels: np.ndarray, sizes: np.ndarray, widths: np.ndarray, top: bool) -> None:
    """Write each image's colour cache bits, codes and pixels into its stream, in ``IMAGE_SECTIONS`` sections."""
    m = len(stream)
    image = np.repeat(np.arange(m), sizes)
    start, length, distance = _copies(pixels, image, m)
    of = image[start]
    copied = np.zeros(len(pixels) + 1, np.int8)
    copied[start] += 1
    copied[start + length] -= 1
    literal = np.cumsum(copied[:-1]) == 0
    channel = [pixels >> s & 255 for s in (8, 16, 0, 24)]
    code = np.zeros_like(distance)
    for width in np.unique(widths[of]).tolist():
        near = _near_codes(width)
        rows = (widths[of] == width) & (distance < len(near))
        code[rows] = near[distance[rows]]
    l_prefix, l_extra, l_width = _prefixes(length)
    d_prefix, d_extra, d_width = _prefixes(np.where(code > 0, code, distance + len(_NEAR)))

    slot = (_CACHE * pixels & 0xFFFFFFFF) >> (32 - CACHE_BITS)
    key = image << CACHE_BITS | slot
    order = np.argsort(key.astype(np.min_scalar_type(m << CACHE_BITS)), kind="stable")
    hit = np.zeros(len(pixels), bool)
    hit[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
    hit &= literal & (sizes >= 64)[image]
    first_size = 280 + (1 << CACHE_BITS)
    ends = np.bincount(of * first_size + 256 + l_prefix, minlength=m * first_size)

    def counted(plain: np.ndarray, cached: np.ndarray):
        """(estimate, counts of the first code's symbols, of red's, of blue's) by image."""
        here = image[plain]
        first = ends + np.bincount(here * first_size + channel[0][plain], minlength=m * first_size)
        if len(cached):
            first += np.bincount(image[cached] * first_size + 280 + slot[cached], minlength=m * first_size)
        first = first.reshape(m, -1)
        red, blue = (np.bincount(here * 256 + channel[k][plain], minlength=m * 256).reshape(m, 256) for k in (1, 2))
        each, symbols = np.bincount(here, minlength=m), sum((c > 0).sum(axis=1) for c in (first, red, blue))
        return _entropy(first, first.sum(axis=1)) + _entropy(red, each) + _entropy(blue, each) + 6 * BIT * symbols, first, red, blue

    cached = np.flatnonzero(hit)
    without = counted(np.flatnonzero(literal), cached[:0])
    cache = np.zeros(m, bool)
    counts = list(without[1:])
    if len(cached):
        with_ = counted(np.flatnonzero(literal & ~hit), cached)
        cache = with_[0] < without[0]
        counts = [np.where(cache[:, None], a, b) for a, b in zip(with_[1:], without[1:], strict=True)]
        cached = cached[cache[image[cached]]]
    kind = literal.astype(np.int8)  # 1: a pixel of its own, 2: from the cache, 3: a copy begins
    kind[cached] = 2
    kind[start] = 3
    plain = kind == 1
    counts.append(np.bincount(image[plain] * 256 + channel[3][plain], minlength=m * 256).reshape(m, 256))
    counts.append(np.bincount(of * 40 + d_prefix, minlength=m * 40).reshape(m, 40))
    flags = np.column_stack([cache, np.full(m, CACHE_BITS), np.zeros(m, np.int64)])
    out.put(section, stream, flags, np.column_stack([np.ones(m, np.int64), 4 * cache, np.full(m, int(top))]))
    codes = []
    for k, c in enumerate(counts):
        lengths = _lengths_of(c)
        _put_codes(out, section + 1 + 2 * k, stream, lengths)
        codes.append(_codes_of(lengths))
    order = np.flatnonzero(kind)
    what, whose = kind[order], image[order]
    values, bits = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)

    def add(rows, parts):
        """A pixel's or a copy's numbers, at most 50 bits together, as one."""
        value, taken = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for v, n in parts:
            value |= v << taken
            taken += n
        values[rows], bits[rows] = value, taken

    rows = np.flatnonzero(what == 1)
    add(rows, ((c[0][at], c[1][at]) for c, at in ((codes[k], (whose[rows], channel[k][order[rows]])) for k in range(4))))
    rows = np.flatnonzero(what == 2)
    at = whose[rows], 280 + slot[order[rows]]
    add(rows, [(codes[0][0][at], codes[0][1][at])])
    at, far = (of, 256 + l_prefix), (of, d_prefix)
    add(np.flatnonzero(what == 3), [(codes[0][0][at], codes[0][1][at]), (l_extra, l_width), (codes[4][0][far], codes[4][1][far]), (d_extra, d_width)])
    out.put(section + 11, stream[whose], values[:, None], bits[:, None])


def _share(of: np.ndarray, by: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The multiplier, in 32nds, that takes most of one signed channel out of another, by image."""

    begin = np.cumsum(sizes) - sizes
    x, y, squares, products = np.add.reduceat(np.stack([by, of, by * by, by * of]), begin, axis=1)
    power, both = sizes * squares - x * x, sizes * products - x * y
    return np.where(power > 0, np.clip(np.rint(32 * (both / np.maximum(power, 1))), -128, 127), 0).astype(np.int64)


def encode_all(pictures: list[np.ndarray]) -> list[bytes]:
    """Each picture of height by width by 3 samples of 8 bits as a file, made together, as each would be alone. Of a palette,
    the cross-colour transform, the predictors of the left and the upper pixel, and none, the one that is estimated to take
    the fewest bits is used."""
    if not pictures:
        return []
    heights, widths = (np.array([p.shape[k] for p in pictures], np.int64) for k in (0, 1))
    if max(heights.max(), widths.max()) > SIDE:
        raise ValueError(f"an image of more than {SIDE} rows or columns")
    m, sizes = len(pictures), heights * widths
    flat = np.concatenate([np.asarray(p, np.uint8).reshape(-1, 3) for p in pictures])
    image = np.repeat(np.arange(m), sizes)
    begin = np.cumsum(sizes) - sizes
    y, x = np.divmod(np.arange(len(flat)) - begin[image], widths[image])
    red, green, blue = (flat[:, k].astype(np.int64) for k in range(3))
    rgb = red << 16 | green << 8 | blue

    def cost(samples):
        at = (image * 768)[:, None] + _PLACES + samples
        return _entropy(np.bincount(at.reshape(-1), minlength=768 * m).reshape(m, 768), sizes, 3)

    def rest(mode):
        """What the predictor of the left (1) or upper (2) pixel leaves; at the edges the format fixes the other."""
        here = np.arange(len(flat))
        source = np.where((y == 0) | ((x > 0) & (mode == 1)), here - 1, here - widths[image])
        guess = flat[np.maximum(source, 0)]
        guess[begin] = 0
        return flat - guess

    signed = flat.view(np.int8).astype(np.int64)
    to_red, to_blue = (_share(signed[:, k], signed[:, 1], sizes) for k in (0, 2))
    crossed = flat.copy()
    crossed[:, 0] -= (to_red[image] * signed[:, 1] >> 5).astype(np.uint8)
    crossed[:, 2] -= (to_blue[image] * signed[:, 1] >> 5).astype(np.uint8)
    ways = [flat, rest(1), rest(2), crossed]
    costs = np.stack([cost(w) for w in ways])
    costs[1:] += 80 * BIT
    costs[3, (to_red == 0) & (to_blue == 0)] = np.iinfo(np.int64).max
    way = costs.argmin(axis=0)
    colours, index, seen = np.unique(image << 24 | rgb, return_inverse=True, return_counts=True)
    whose = colours >> 24
    shades = np.bincount(whose, minlength=m)
    few = _times_log(sizes) - np.bincount(whose, _times_log(seen), m).astype(np.int64) + 20 * BIT * shades
    way[(shades <= 256) & (few < costs[0] + 64 * BIT)] = 4

    one, all_ = np.ones(m, np.int64), np.arange(m)
    out = Streams(m, 4 + 2 * IMAGE_SECTIONS)
    out.put(0, all_, np.column_stack([widths - 1, heights - 1, 0 * one]), np.array([[14, 14, 4]]))  # no alpha, version 0
    named = np.flatnonzero(way)
    kinds = np.array([0, PREDICTOR, PREDICTOR, CROSS_COLOUR, PALETTE])[way[named]]
    listed = kinds == PALETTE
    out.put(1, named, np.column_stack([one[named], kinds, np.where(listed, shades[named] - 1, 7)]), np.column_stack([one[named], 2 * one[named], np.where(listed, 8, 3)]))
    table = way == 4
    tiled = np.flatnonzero((way > 0) & ~table)
    if len(tiled):  # tiles of 512, all alike
        element = np.where(way[tiled] == 3, (to_blue[tiled] & 255) << 8 | to_red[tiled] & 255, way[tiled] << 8)
        across = -(-widths[tiled] >> 9)
        tiles = across * -(-heights[tiled] >> 9)
        _put_images(out, 2, tiled, np.repeat(OPAQUE | element, tiles), tiles, across, False)
    packed = np.where(table, 3 - np.searchsorted([2, 4, 16], shades), 0)  # 3: eight pixels in one, 0: each on its own
    if table.any():
        ours = table[whose]
        step = np.stack([colours[ours] >> s & 255 for s in (16, 8, 0)], axis=-1)
        later = np.diff(whose[ours], prepend=-1) == 0
        step[1:] -= np.where(later[1:, None], step[:-1].copy(), 0)
        step &= 255
        steps = np.where(later, 0, OPAQUE) | step[:, 0] << 16 | step[:, 1] << 8 | step[:, 2]
        _put_images(out, 2, np.flatnonzero(table), steps, shades[table], shades[table], False)
    across = -(-widths >> packed)
    new_sizes = across * heights
    new_begin = np.cumsum(new_sizes) - new_sizes
    at = new_begin[image] + y * across[image] + (x >> packed[image])
    samples = flat.copy()
    for k in (1, 2, 3):
        rows = np.flatnonzero((way == k)[image])
        samples[rows] = ways[k][rows]
    alpha = np.where((way == 1) | (way == 2), 0, OPAQUE)[image]
    whole = alpha | samples[:, 0].astype(np.int64) << 16 | samples[:, 1].astype(np.int64) << 8 | samples[:, 2]
    pixels = np.zeros(int(new_sizes.sum()), np.int64)
    plain = ~table[image]
    pixels[at[plain]] = whole[plain]
    if table.any():
        held = packed[image]
        number = index.reshape(-1) - (np.cumsum(shades) - shades)[image]
        shifted = number << ((x & ((1 << held) - 1)) * (8 >> held))
        pixels += np.bincount(at, np.where(plain, 0, shifted << 8), len(pixels)).astype(np.int64)
        pixels[np.repeat(table, new_sizes)] |= OPAQUE
    out.put(2 + IMAGE_SECTIONS, all_, np.zeros((m, 1), np.int64), np.ones((m, 1), np.int64))
    _put_images(out, 3 + IMAGE_SECTIONS, all_, pixels, new_sizes, across, True)
    return [wrap(s) for s in out.bytes()]


def encode(samples: np.ndarray) -> bytes:
    """One picture as a file."""
    return encode_all([samples])[0]
