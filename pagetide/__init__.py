"""pagetide: page-corpus analytics and release tracking as Spark jobs."""

from pagetide.session import open_session

__all__ = ["open_session"]
