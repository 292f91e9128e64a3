"""Statuses as exceptions. `status` is the name a caller can match on."""

from __future__ import annotations


class StoreError(Exception):
    status = "internal"


def _error(name: str, status: str) -> type[StoreError]:
    return type(name, (StoreError,), {"status": status, "__module__": __name__})


InvalidArgument = _error("InvalidArgument", "invalid_argument")
NotFound = _error("NotFound", "not_found")
AlreadyExists = _error("AlreadyExists", "already_exists")
Corruption = _error("Corruption", "corruption")
ChecksumMismatch = _error("ChecksumMismatch", "checksum_mismatch")
KeyCollision = _error("KeyCollision", "key_collision")
PreconditionFailed = _error("PreconditionFailed", "precondition_failed")
PermissionDenied = _error("PermissionDenied", "permission_denied")
Busy = _error("Busy", "busy")
Cancelled = _error("Cancelled", "cancelled")
UnsupportedFeature = _error("UnsupportedFeature", "unsupported_feature")
UnsupportedCodec = _error("UnsupportedCodec", "unsupported_codec")
CodecMismatch = _error("CodecMismatch", "codec_mismatch")
BufferTooSmall = _error("BufferTooSmall", "buffer_too_small")
NoPatchPath = _error("NoPatchPath", "no_patch_path")
PatchIntentMismatch = _error("PatchIntentMismatch", "patch_intent_mismatch")
OverlayBaseMismatch = _error("OverlayBaseMismatch", "overlay_base_mismatch")
BatchClosed = _error("BatchClosed", "batch_closed")
