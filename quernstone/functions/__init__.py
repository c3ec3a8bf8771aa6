"""Part of quernstone; see README.md."""
