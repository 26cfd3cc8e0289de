from journeykit.streaming.flatten_stream import stream_flat_events

__all__ = ["stream_flat_events"]
