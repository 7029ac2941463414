"""Engine settings."""

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Sizes are in code points of key plus value, as in :func:`palimpsest.operators.layout.cell_size`."""

    max_memtable_size: int = 4096
    max_l0_files: int = 2
    bloom_false_positive_rate: float = 0.01
    sparse_index_n: int = 4
    wal_buffer_size: int = 100
    log_compaction_threshold: int = 10_000
    #: Levels grow by this factor, in files and in the size of one file.
    level_factor: int = 10

    def level_file_limit(self, level: int) -> int:
        """Files that ``level`` may hold before it is compacted into the next one."""
        return self.max_l0_files * (self.level_factor**level if level else 1)

    def level_chunk_size(self, level: int) -> int:
        """Size at which a file of ``level`` is closed."""
        return self.max_memtable_size * self.level_factor**level
