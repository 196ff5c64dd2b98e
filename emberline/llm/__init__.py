"""Operators of a training-data pipeline: deduplication, language, decontamination, packing, archives, media, chats."""
