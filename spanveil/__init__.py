"""De-identification of conversation transcripts on Spark."""

__all__ = ["Config", "Engine", "register", "release_view"]
__version__ = "0.2.0"


def __getattr__(name: str):
    # loaded on first use: executors of other parts don't need them
    if name in ("Engine", "release_view"):
        from .plans import engine

        return getattr(engine, name)
    if name in ("Config", "register"):
        from .plans import policy

        return getattr(policy, name)
    raise AttributeError(name)
