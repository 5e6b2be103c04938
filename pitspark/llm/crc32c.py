"""CRC-32C of many byte strings at once.

A CRC is linear over bits: the value of a message is the exclusive or of what each byte adds,
advanced over the bytes that follow it. Messages are padded in front with zero bytes (which add
nothing to a register that starts at 0) to whole blocks, all blocks are looked up together, and each
block is advanced by its distance from the end, bit by bit of that distance.
"""

from __future__ import annotations

import functools

import numpy as np

POLYNOMIAL = 0x82F63B78  # Castagnoli, reflected
BLOCK = 64
MASK_DELTA = 0xA282EAD8


@functools.lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


def _zero_byte(register: np.ndarray) -> np.ndarray:
    return _byte_table()[register & 0xFF] ^ (register >> np.uint32(8))


@functools.lru_cache(maxsize=1)
def _block_tables() -> np.ndarray:
    rows = [_byte_table()]
    for _ in range(BLOCK - 1):
        rows.append(_zero_byte(rows[-1]))
    return np.stack(rows[::-1])


def _apply(tables: np.ndarray, register: np.ndarray) -> np.ndarray:
    out = tables[0][register & 0xFF]
    for k in range(1, 4):
        out = out ^ tables[k][(register >> np.uint32(8 * k)) & 0xFF]
    return out


@functools.lru_cache(maxsize=64)
def _advance_tables(level: int) -> np.ndarray:
    """Tables that advance a register over 2**level zero bytes."""
    unit = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    if level == 0:
        return np.stack([_zero_byte(row) for row in unit])
    half = _advance_tables(level - 1)
    return np.stack([_apply(half, row) for row in half])


def _advance(register: np.ndarray, distance: np.ndarray) -> np.ndarray:
    level = 0
    while (left := distance >> level).any():
        moved = (left & 1).astype(bool)
        if moved.any():
            register = register.copy()
            register[moved] = _apply(_advance_tables(level), register[moved])
        level += 1
    return register


def crc32c(messages: list[bytes]) -> np.ndarray:
    """The CRC-32C of each message, as uint32."""
    if not messages:
        return np.zeros(0, dtype=np.uint32)
    lengths = np.array([len(m) for m in messages], dtype=np.int64)
    blocks = np.maximum(1, -(-lengths // BLOCK))
    ends = np.cumsum(blocks)
    data = np.zeros(int(ends[-1]) * BLOCK, dtype=np.uint8)
    for message, end in zip(messages, ends):
        if message:
            data[int(end) * BLOCK - len(message) : int(end) * BLOCK] = np.frombuffer(message, dtype=np.uint8)
    cells = data.reshape(-1, BLOCK)
    tables = _block_tables()
    registers = np.zeros(len(cells), dtype=np.uint32)
    for k in range(BLOCK):
        registers ^= tables[k][cells[:, k]]
    from_end = np.repeat(ends, blocks) - 1 - np.arange(len(cells))
    registers = _advance(registers, from_end * BLOCK)
    whole = np.bitwise_xor.reduceat(registers, ends - blocks)
    start = _advance(np.full(len(messages), 0xFFFFFFFF, dtype=np.uint32), lengths)
    return whole ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """The rotation and offset that keep a checksum of data holding checksums apart from it."""
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)
