"""Messages as they arrive: files as a stream, duplicates within a delay, sessions and daily counts that close by watermark."""
