"""Column-expression functions (JVM-side, codegen-friendly): box algebra and waveform arrays."""
