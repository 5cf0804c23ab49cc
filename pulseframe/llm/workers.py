"""What a Python worker keeps from one task to its later ones."""

from __future__ import annotations


def kept(name: str) -> dict:
    """A dict of this process.

    Where the package is not installed on the workers, its functions and their globals travel with each task, so a
    global would be new in each; a module that is made in the process itself stays.
    """
    import sys
    import types

    return sys.modules.setdefault("pulseframe_kept", types.ModuleType("pulseframe_kept")).__dict__.setdefault(name, {})


def released(run, uses: tuple[str, ...] = ()):
    """run(batches) -> batches, before which the worker forgets what it kept under other names than `uses`, and after
    which what the task has freed goes back to the system.

    An idle worker stays beside those of later stages, and allocators keep what was freed for reuse.
    """

    def f(batches):
        import ctypes
        import sys
        import types

        import pyarrow as pa

        for name, values in vars(sys.modules.get("pulseframe_kept", types.SimpleNamespace())).items():
            if name not in uses and not name.startswith("__"):
                values.clear()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim is not None:
            trim(0)

    return f
