"""Training-data operators: extraction, scanning, filtering, mixing, joining, encoding and packing of documents."""
