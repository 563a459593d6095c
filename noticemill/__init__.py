"""Corporate-action notice processing as Spark DataFrame jobs."""

from noticemill.session import build_session

__all__ = ["build_session"]
