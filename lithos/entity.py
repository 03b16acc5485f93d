"""Entity ids: a generation in the high 32 bits, an index in the low 32."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A reference that never resolves. Spark has no unsigned 64-bit type.
DANGLING = -1
_LOW = (1 << 32) - 1


def pack(generation: int, index: int) -> int:
    """Signed 64-bit id of an index at a generation."""
    bits = ((generation & _LOW) << 32) | (index & _LOW)
    return bits - (1 << 64) if bits >> 63 else bits


def index_of(entity: int) -> int:
    return entity & _LOW


def generation_of(entity: int) -> int:
    return (entity >> 32) & _LOW


def index_column(entity: Column) -> Column:
    return entity.bitwiseAND(F.lit(_LOW))


def generation_column(entity: Column) -> Column:
    return F.shiftrightunsigned(entity, 32)


class EntityAllocator:
    """Hands out ids. Freed indexes come back last-freed first, one generation
    later; ranges for distributed spawns are always fresh."""

    def __init__(self) -> None:
        self.next_index = 0
        self._free: list[int] = []
        self._generation: dict[int, int] = {}

    def allocate(self) -> int:
        if self._free:
            index = self._free.pop()
            return pack(self._generation[index], index)
        self.next_index += 1
        return self.next_index - 1

    def reserve(self, n: int) -> int:
        """First of ``n`` consecutive fresh ids."""
        first = self.next_index
        self.next_index += n
        return first

    def free(self, entity: int) -> None:
        index = index_of(entity)
        self._generation[index] = generation_of(entity) + 1
        self._free.append(index)

    def observe(self, entity: int) -> None:
        """Never hand out an id at or below one that was loaded."""
        self.next_index = max(self.next_index, index_of(entity) + 1)
