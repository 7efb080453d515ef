"""Writers: documents, versioned tables, partitioned stores."""
