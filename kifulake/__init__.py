"""kifulake: corpus analytics for scored board-game positions, as Spark jobs."""
