from .scalar import *  # noqa: F403
