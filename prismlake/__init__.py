"""prismlake: a media-index analytics engine expressed as Spark DataFrame programs."""
