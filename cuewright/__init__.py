"""cuewright: timed-text analytics on Spark (words, segments, cues, readings, clips)."""
