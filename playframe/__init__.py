"""playframe: spatio-temporal tracking and event analytics as Spark jobs."""

from playframe.config import EngineConfig
from playframe.session import get_session

__all__ = ["EngineConfig", "get_session"]
