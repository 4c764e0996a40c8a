"""Training-data operators: tokens, near copies, repeats, licences, decontamination, packing and archives."""
