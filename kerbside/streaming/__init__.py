"""At-least-once processing of survey messages with Structured Streaming."""
