"""Training-data operators: packing, media columns, token counts, secrets, fixity, near-duplicates,
decontamination, language identification, main-text extraction and personal data."""
